"""Plans on small tables: rules, order, sources, listing pages, judging, search."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import models, order, qa, rules, search
from tesserae.plans import standins
from tesserae.sources import files, pages


def bm25_by_hand(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / mean)) for w in query) for d in docs]


def test_bm25(spark):
    texts = ["a b c", "a a d", "b", "x y z a", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    query = spark.createDataFrame([(0, "a a b nowhere")], "query_id long, text string")
    got = {r["id"]: r["bm25"] for r in search.bm25(docs, search.query_terms(query, "query_id", "text")).collect()}
    want = bm25_by_hand([t.split() for t in texts], "a a b nowhere".split())
    assert all(abs(got.get(i, 0) - w) < 1e-9 for i, w in enumerate(want))


def test_hybrid_alpha_and_single_candidate(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cat sat", "dog ran", "cat dog", "bird", "fish"])], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    text, q = spark.createDataFrame([(0, "cat")], "query_id long, text string"), spark.createDataFrame([([3.0, 1.0],)], "q array<double>")
    by_vector = [r["id"] for r in search.hybrid_search(docs, vectors, text, q, k=4, alpha=1.0).orderBy("rank").collect()]
    assert by_vector == [3, 2, 1, 0]
    by_words = search.hybrid_search(docs, vectors, text, q, k=2, alpha=0.0).orderBy("rank").collect()
    assert by_words[0]["id"] == 0 and by_words[0]["score"] == 1.0
    one = search.hybrid_search(docs.filter("doc_id = 3"), vectors, text, q, alpha=1.0).collect()
    assert [(r["id"], r["score"]) for r in one] == [(3, 0.0)]


def test_recommend_boosts_only_the_top(spark):
    rows = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [0.99, 0.14]), (2, "y", [0.0, 1.0])], "id long, category string, embedding array<double>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    got = search.recommend(rows, q, ["y"], k=2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (0, 1.0)] or [r["id"] for r in got] == [0, 1]


def test_rules_in_order(spark, tmp_path):
    r = rules.Rules({"News": "news"}, {"narrow": ["abc"], "wide": ["ab"]}, "other")
    rows = spark.createDataFrame([("News abc", ""), ("an abc", ""), ("an ab", "abc"), ("zz", "ab"), ("zz", None), (None, None)], "t string, b string")
    assert [x[0] for x in rows.select(rules.infer_category(r, "t", "b")).collect()] == ["news", "narrow", "wide", "wide", "other", "other"]
    assert [x[0] for x in rows.select(rules.infer_category(r, "t")).collect()][3] == "other"
    path = tmp_path / "rules.json"
    path.write_text('{"prefixes": {"A": "a"},\n "keywords": {"b": ["c"]}, "default": "d"}')
    assert rules.Rules.read(spark, str(path)) == rules.Rules({"A": "a"}, {"b": ["c"]}, "d")
    assert r.table(spark).count() == 5


def test_positions_and_stop(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert sorted((r["k"], r["position"]) for r in order.with_position(rows, "k").collect()) == [(i, i) for i in range(1000)]
    kept = order.before_stop(rows, F.col("k") % 100 == 99, "k")
    assert kept.count() == 99 and order.before_stop(rows, F.col("k") < 0, "k").count() == 1000
    empty = order.with_position(rows.filter("k < 0"), "k")
    assert empty.count() == 0


def test_splits(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("label"))
    split = order.hashed_split(rows, "id")
    assert split.filter("split = 'eval'").count() == 50
    assert order.hashed_split(rows.limit(20), "id").filter("split = 'train'").count() == 0
    share = order.stratified_split(rows, "label", "id").filter("split = 'eval'").count()
    assert 10 < share < 60


def test_upsert_and_resume(spark, tmp_path):
    index = spark.createDataFrame([("a", "1"), ("b", "1")], "doc_id string, v string")
    new = spark.createDataFrame([("b", "2", 1), ("b", "3", 2), ("c", "2", 3)], "doc_id string, v string, at int")
    once = files.upsert(index, new, ordinal="at")
    assert sorted(map(tuple, once.collect())) == [("a", "1"), ("b", "3"), ("c", "2")]
    assert sorted(map(tuple, files.upsert(once, new, ordinal="at").collect())) == sorted(map(tuple, once.collect()))
    path = str(tmp_path / "lines")
    assert files.read_json_lines(spark, path, "question string").count() == 0
    spark.createDataFrame([('{"question": "q1"}',), ("",), ("{bad",), ('{"other": 1}',)], "value string").write.mode("append").text(path)
    assert [r["question"] for r in files.read_json_lines(spark, path, "question string", required="question").collect()] == ["q1"]
    files.write_json(once, str(tmp_path / "out"))
    assert files.read_json_array(spark, str(tmp_path / "out"), "doc_id string, v string").count() == 3
    (tmp_path / "array.json").write_text('[{"doc_id": "a"},\n {"doc_id": "b", "v": "한"}]')
    assert sorted(map(tuple, files.read_json_array(spark, str(tmp_path / "array.json"), "doc_id string, v string").collect())) == [("a", None), ("b", "한")]
    assert files.read_json_array(spark, str(tmp_path / "nowhere"), "doc_id string").count() == 0
    assert files.scan(index.withColumn("category", F.lit("x")), "y").count() == 0


LISTING = """<table><tr><th>h</th></tr>
<tr class="row notice"><td class="td-title"><a href="/p">Pinned</a></td><td class="td-date">2026.01.09</td></tr>
<tr><td class="td-title"><a href="/v?id=1&layout=x">학사 First 새글</a></td><td class="td-date"> 2026.01.08 </td></tr>
<tr><td class="td-title"><a href="http://e.org/2">Second</a></td><td class="td-date">2025.12.31</td></tr>
<tr><td class="td-title"><a href="/3">No date</a></td></tr>
<tr><td class="td-title"><a href="/4">Third</a></td><td class="td-date">2026.01.01</td></tr></table>"""


def test_listing(spark):
    table = spark.createDataFrame([(1, LISTING), (5, LISTING), (6, LISTING), (7, None)], "page int, html string")
    items = pages.listing_items(table, pages.Board(host="http://h.kr", labels=("학사", "장학")))
    first = items.filter("page = 1").orderBy("position").collect()
    assert [(r["title"], r["url"], r["date"]) for r in first] == [("First", "http://h.kr/v?id=1", "2026.01.08"), ("Second", "http://e.org/2", "2025.12.31"), ("Third", "http://h.kr/4", "2026.01.01")]
    kept = pages.of_year(items, "2026").orderBy("page", "position").collect()
    assert [(r["page"], r["title"]) for r in kept] == [(1, "First"), (1, "Third"), (5, "First")]
    until = pages.until_older(items, "2026").collect()
    assert [(r["page"], r["title"]) for r in until] == [(1, "First")]
    below = LISTING.replace('class="row notice"', "").replace('class="td-title"><a href="/p"', 'class="td-title"><b class="notice">x</b><a href="/p"')
    assert pages.listing_items(spark.createDataFrame([(1, below)], "page int, html string"), pages.Board(pinned="descendant")).count() == 3


def test_bodies(spark):
    html = '<div class="x">no</div><div class="txt"> Hi <b>there</b><script>var a;</script><!-- c --><br><img src="/a.png"><img src="/logo.png"><a href="/download/1">Plan.PDF</a><a href="/z">z</a><div>more</div></div><p>after</p>'
    row = pages.bodies(spark.createDataFrame([("u", html), ("v", None)], "url string, html string"), "txt", "http://h").orderBy("url").collect()
    assert row[0]["text"] == "Hi there Plan.PDF z more" and row[0]["images"] == ["http://h/a.png"] and row[0]["pdfs"] == ["http://h/download/1"]
    assert row[1]["text"] == ""
    parts = spark.createDataFrame([("u", 2, "ocr", "scan"), ("u", 1, "text", "body"), ("u", 3, "pdf", " ")], "url string, ordinal int, kind string, text string")
    assert pages.full_body(parts).collect()[0]["body"] == "body [OCR] scan"


def test_tiles(spark):
    heights = spark.createDataFrame([(h,) for h in (50, 1500, 1501, 2900, 2901)], "h int")
    got = [[tuple(t) for t in r[0]] for r in heights.orderBy("h").select(pages.ocr_tiles(F.col("h"))).collect()]

    def by_loop(h):
        out, y = [], 0
        while True:
            end = min(y + 1500, h)
            out.append((y, end))
            if end == h:
                return out
            y = end - 100

    assert got == [by_loop(h) for h in (50, 1500, 1501, 2900, 2901)]


def test_recognise_survives_errors(spark):
    rows = spark.createDataFrame([("a", bytearray(b"one|two")), ("b", bytearray(b"!"))], "path string, content binary")

    def engine(content):
        if content == b"!":
            raise ValueError("unreadable")
        return content.decode().split("|")

    assert [(r["path"], r["text"]) for r in pages.recognise(rows, engine, pages=1).collect()] == [("a", "one")]


def test_judge(spark):
    rows = [("q1", "A fact that is in the notice.", "A fact that is in the notice"), ("q2", "no", "x"), ("q3", "Invented long claims. Another one here?", "x")]
    judged = {r["question"]: r for r in qa.judge(spark.createDataFrame(rows, "question string, answer string, notice string"), standins.EchoTextModel()).collect()}
    assert judged["q2"]["unchecked"] and not judged["q2"]["hallucination"]
    assert not judged["q1"]["hallucination"] and not judged["q1"]["needs_review"]
    bad = judged["q3"]
    assert (bad["hallucination"] and bad["judge_score"] == 0 and bad["judge_reason"].startswith("[HALLUCINATION]")) or bad["needs_review"]
    stats = qa.verdict_stats(spark.createDataFrame([("passed",), ("low",), ("hallucinated",)], "verdict string"), skipped=1).first()
    assert (stats["total"], stats["passed_rate"]) == (4, 25.0)
    none = qa.verdict_stats(spark.createDataFrame([], "verdict string")).first()
    assert none["total"] == 0 and none["low_rate"] == 0.0


def test_seed_questions(spark):
    body = "This sentence is long enough. " * 12
    made = qa.seed_questions(spark.createDataFrame([(1, "t", body), (2, "t", "short")], "notice_id long, title string, body string"))
    assert made.count() == 5 and {r["notice_id"] for r in made.collect()} == {1}


def test_embed_and_fallbacks(spark):
    rows = spark.createDataFrame([("a b",), ("",)], "t string")
    vectors = [r[0] for r in rows.select(models.embed("t")).collect()]
    assert len(vectors[0]) == 64 and abs(sum(x * x for x in vectors[0]) - 1) < 1e-5 and sum(map(abs, vectors[1])) == 0
    assert rows.select(models.summarize(F.lit("t"), F.lit("tiny"))).first()[0] == "tiny"
    assert rows.select(models.classify(F.lit("t"), F.lit("b"), F.lit("rule"), ["x"])).first()[0] == "rule"


def test_plans(spark, tmp_path):
    spark.range(10).select("id", F.lit("x").alias("category"), F.lit("t").alias("text")).write.parquet(str(tmp_path / "t"))
    index = spark.read.parquet(str(tmp_path / "t"))
    plan = files.scan(index, "x").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(category,x)" in plan and "text" not in plan.partition("ReadSchema")[2]
    top = index.orderBy(F.desc("id")).limit(3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
    assert "Python" not in index.select(T.clean_title("text", ("Label",)), T.clean_url("text"))._jdf.queryExecution().executedPlan().toString()


def failing(message, times):
    """A model that fails so many times with a message, then answers. Its class is local, so that workers need not import it."""

    class Failing:
        def __init__(self):
            self.message, self.times = message, times

        def load(self):
            left = [self.times]

            def reply(prompts):
                left[0] -= 1
                if left[0] >= 0:
                    raise RuntimeError(self.message)
                return ["fine"] * len(prompts)

            return reply

    return Failing()


def test_replies_retry_rate_limits_only():
    waits = []
    assert models.replies(failing("429: retryDelay: 7s", 2), ["a", "b"], waits.append) == ["fine", "fine"] and waits == [9, 9]
    assert models.replies(failing("429", 4), ["a"], waits.append) == ["fine"] and waits[2:] == [60] * 4
    with pytest.raises(RuntimeError, match="5 tries"):
        models.replies(failing("429 again", 5), ["a"], waits.append)
    with pytest.raises(RuntimeError, match="denied"):
        models.replies(failing("denied", 1), ["a"], waits.append)
    assert len(waits) == 10


def test_judging_fails_with_its_model(spark):
    pairs = spark.createDataFrame([("q", "a claim that is long enough.", "notice")], "question string, answer string, notice string")
    with pytest.raises(Exception, match="denied"):
        qa.judge(pairs, failing("denied", 99)).collect()
    assert pairs.select(models.summarize(F.col("question"), F.col("answer"), failing("denied", 99))).first()[0] == "a claim that is long enough."


def texts_engine():
    """An engine whose class is local, so that workers need not import it."""

    class Texts:
        """An engine for tests: pictures as arrays in text, PDF files as lines of pages, with a picture where a page is a number."""

        def decode(self, content):
            import numpy as np

            h, w = map(int, content.split(b"x"))
            return np.full((h, w), 200, dtype=np.uint8) if h else None

        def read(self, picture, form):
            return [f"{form} {picture.shape[0]}", " "]

        def pdf_text(self, content):
            return [line if not line.isdigit() else None for line in content.decode().split("|")]

        def pdf_pictures(self, content, pages):
            return [self.decode(b"%dx900" % int(p)) for p in content.decode().split("|") if p.isdigit()][:pages]

    return Texts()


def test_recognised_files(spark):
    rows = [("u/a.png", b"2000x900"), ("u/b.jpg", b"29x900"), ("u/c.png", b"40x99"), ("u/d.png", b"broken"), ("u/e.pdf", b" page one | page two"), ("u/f.pdf", b"900|1000"), ("u/g.pdf", b"|".join([b"p"] * 12)), ("u/h", b"0x0")]
    got = {r["path"]: r["text"] for r in pages.recognised(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), texts_engine()).collect()}
    assert got == {"u/a.png": "png 1500 png 600", "u/e.pdf": "page one   page two", "u/f.pdf": "jpg 900\njpg 1000", "u/g.pdf": " ".join(["p"] * 10)}


def test_full_bodies_in_the_order_of_the_page(spark):
    html = '<div class="txt">Text<p><img src="/b.png"><img src="/a.png"><a href="/download/1">x.pdf</a></div><img src="/out.png">'
    posts = spark.createDataFrame([("p", html), ("q", "<p>no such element</p>")], "url string, html string")
    files_ = spark.createDataFrame([("http://h/a.png", bytearray(b"900x900")), ("http://h/b.png", bytearray(b"1000x900")), ("http://h/out.png", bytearray(b"999x900")), ("http://h/download/1", bytearray(b"the plan"))], "path string, content binary")
    got = {r["url"]: r["body"] for r in pages.full_bodies(posts, files_, texts_engine(), "txt", "http://h").collect()}
    assert got == {"p": "Text x.pdf [OCR] png 1000 [OCR] png 900 [PDF] the plan", "q": ""}


def test_pictures():
    import numpy as np

    from tesserae.operators import images

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (60, 90)).astype(float)
    t = images.best_threshold(image)
    values = image.astype(np.uint8)

    def between(k):
        a, b = values[values <= k], values[values > k]
        return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else -1

    assert between(t) >= max(map(between, range(255))) * (1 - 1e-9)
    assert images.white_ratio(np.array([[255, 0], [0, 0]])) == 0.25 and images.white_ratio(np.zeros((0, 0))) == 0.0
    assert images.enlarged(image).shape == (800, 1200) and images.enlarged(np.ones((900, 850))).shape == (900, 850)
    assert np.allclose(images.enlarged(np.full((10, 20), 7.0)), 7.0)
    flat = np.full((900, 900), 250.0)  # one threshold would make it one colour
    flat[400:404, 100:800] = 248
    assert 0 < images.white_ratio(images.binarized(flat)) and set(np.unique(images.binarized(flat))) <= {0, 255}
    page = np.full((120, 300), 180, dtype=np.uint8)
    page[40:60, 50:250] = 120  # a faint line
    ready = images.prepared(np.repeat(page[..., None], 3, axis=2))
    assert ready.shape == (800, 2000, 3) and ready[330, 1000].max() < 60 and ready[700, 1000].min() > 200
    assert images.tiles(1500) == [(0, 1500)] and images.tiles(1501) == [(0, 1500), (1400, 1501)]
    plain = standins.PlainEngine()
    assert plain.decode(b"P5 3 2 255\nabcdef").shape == (2, 3) and plain.decode(b"GIF89a") is None


def test_crawl_stops_at_a_page_of_other_years(spark):
    row = lambda k, date: f'<tr><td class="td-title"><a href="/{k}">T{k}</a></td><td class="td-date">{date}</td></tr>'
    new, old = "2026.01.01", "2025.01.01"
    crawl = lambda listing: sorted(r["title"] for r in pages.crawl_all(spark.createDataFrame([(n, f"<table>{h}</table>") for n, h in listing], "page int, html string"), spark.createDataFrame([], "url string, html string"), "2026", rules.Rules()).collect())
    assert crawl([(1, row(1, new) + row(2, old) + row(3, new)), (2, row(4, old)), (3, row(5, new))]) == ["T1", "T3"]
    assert crawl([(1, row(1, new)), (2, ""), (3, row(5, new))]) == ["T1"]
    assert crawl([(n, row(n, new)) for n in range(1, 5)] + [(5, row(5, new) + row(6, old) + row(7, new)), (6, row(8, new))]) == ["T1", "T2", "T3", "T4", "T5"]
    assert crawl([(1, row(1, old))]) == []


def test_json_arrays(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(k, None if k % 2 else f'"{k}"\n한') for k in range(20)], "a int, `b c` string").repartition(3)
    files.write_json(rows, path)
    assert sorted(map(tuple, files.read_json_array(spark, path, "a int, `b c` string").collect())) == sorted(map(tuple, rows.collect()))
    import json

    loaded = [x for f in (tmp_path / "out").glob("part-*") for x in json.loads(f.read_text())]
    assert len(loaded) == 20 and all(x.keys() == {"a", "b c"} for x in loaded) and any("한" in f.read_text() for f in (tmp_path / "out").glob("part-*"))
    files.write_json(rows.limit(0), path)
    assert files.read_json_array(spark, path, "a int").count() == 0


def test_settings_and_profiles(spark, tmp_path):
    (tmp_path / "env").write_text("# c\n\nA=1=2\nB = x \nA=3\nnothing\n")
    assert files.read_settings(spark, str(tmp_path / "env")) == {"A": "1=2", "B": "x"} and files.read_settings(spark, str(tmp_path / "none")) == {}
    path = str(tmp_path / "profile")
    assert files.read_profile(spark, path).count() == 0 and not files.delete_profile(spark, path)
    files.write_profile(spark.createDataFrame([("한", None, "t", "1", ["x"])], files.PROFILE), path)
    assert tuple(files.read_profile(spark, path).first()) == ("한", None, "t", "1", ["x"])
    assert files.delete_profile(spark, path) and files.read_profile(spark, path).count() == 0


def test_answers(spark):
    questions = spark.createDataFrame([(1, "when?", "Kim", True), (2, "who?", None, True), (3, "none?", "Lee", False)], "query_id int, question string, name string, is_first boolean")
    hits = spark.createDataFrame([(1, 1, "a", "A", "d"), (1, 2, "b", "B", None), (2, 1, "x", "X", "d")], "query_id int, rank int, url string, title string, date string")
    notices = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 1)], "url string, body string, ordinal int")
    told = {r["query_id"]: r["reply"] for r in search.answers(questions, hits, notices).collect()}
    assert told == {1: "Found 2 related notices.", 2: "Found 1 related notices.", 3: search.NO_HITS}

    class Whole:
        def load(self):
            return lambda prompts: [f" {p} " for p in prompts]

    said = {r["query_id"]: r["reply"] for r in search.answers(questions, hits, notices, Whole()).collect()}
    assert said[1].endswith("Begin with: Hello Kim. \n\nNotices:\n[Notice 1]\nTitle: A\nDate: d\nBody: new\n\n[Notice 2]\nTitle: B\nDate: \nBody: (no body)\n\nQuestion:\nwhen?")
    assert "(no greeting)" in said[2] and "(no body)" in said[2] and said[3] == search.NO_HITS
    failed = {r["query_id"]: r["reply"] for r in search.answers(questions, hits, notices, standins.DigestModel("when?")).collect()}
    assert failed[1] == "[model error] no reply to this prompt" and failed[2].startswith("Reply ")


def test_nearest_takes_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, []), (6, [1.0, 0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, embedding array<double>")
    got = sorted(tuple(r) for r in search.nearest(df, df, 2, "i", "i").select("query_id", "id", "similarity").collect())
    assert got == [(0, 0, 1.0), (0, 2, 1.0), (1, 0, 0.0), (1, 1, 1.0), (2, 0, 1.0), (2, 2, 1.0), (6, 6, 1.0), (8, 0, 0.0), (8, 1, 0.0)]
    assert search.nearest(df.limit(0), df, 2, "i", "i").count() == search.nearest(df, df.limit(0), 2, "i", "i").count() == 0


def test_postings_follow_an_upsert(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, ""), (4, None)], "doc_id int, text string")
    changed = spark.createDataFrame([(2, "x"), (5, "a c")], "doc_id int, text string")
    now = spark.createDataFrame([(1, "a b"), (2, "x"), (3, ""), (4, None), (5, "a c")], "doc_id int, text string")
    terms = search.query_terms(spark.createDataFrame([(0, "a x c c")], "query_id int, text string"), "query_id", "text")
    score = lambda df: {r["id"]: round(r["bm25"], 9) for r in df.collect()}
    held = search.replaced_postings(search.postings(docs), changed)
    assert score(search.bm25_of(held, terms)) == score(search.bm25(now, terms))
    some = now.filter("doc_id <> 5")
    assert score(search.bm25_of(held, terms, some.selectExpr("doc_id as id"))) == score(search.bm25(some, terms))


def test_round_robin_of_a_frequent_group(spark):
    rows = [(k, "often" if k % 3 else None if k % 2 else f"g{k % 30}") for k in range(400)]
    got = {r["k"]: (r["rn"], r["position"], r["batch"]) for r in order.round_robin(spark.createDataFrame(rows, "k int, g string"), "g", "k").collect()}
    first, place = {}, {}
    for k, g in rows:
        place[k] = sum(1 for j, h in rows if h == g and j <= k)
        first.setdefault(g, k)
    want = sorted(rows, key=lambda r: (place[r[0]], first[r[1]]))
    assert got == {k: (place[k], n, n // 64) for n, (k, _) in enumerate(want)}


def test_first_turns(spark):
    rows = spark.createDataFrame([(1, 3), (1, 2), (2, 1), (None, 1)], "conv_id int, turn int")
    assert sorted((r["conv_id"] or 0, r["turn"], r["is_first"]) for r in order.first_turns(rows).collect()) == [(0, 1, False), (1, 2, True), (1, 3, False), (2, 1, True)]


class Trainer:
    """Notes what it was given."""

    def train(self, batches, path):
        self.batches, self.path = list(batches), path


def test_finetune_all(spark):
    from tesserae.operators import training

    notices = spark.createDataFrame([(f"t{k}", "body", "a" if k % 2 else "b") for k in range(200)] + [("x", None, "other")], "title string, body string, category string")
    pairs = spark.createDataFrame([(f"q{k}", f"p{k % 40}") for k in range(200)], "query string, positive string")
    encoder, classifier = Trainer(), Trainer()
    assert training.finetune_all(notices, pairs.limit(0), ["a", "b"], encoder, classifier, "/m") == {"embedding": "no pairs", "classifier": "no pairs"}
    assert training.finetune_all(notices.limit(5), pairs.limit(9), ["a", "b"], encoder, classifier, "/m") == {"embedding": "too few rows", "classifier": "too few rows"}
    assert training.finetune_all(notices, pairs, ["a", "b"], encoder, classifier, "/m") == {"embedding": "trained", "classifier": "trained"}
    assert [len(b) for b in encoder.batches] == [64, 64, 64, 8] and encoder.path == "/m/embedding"
    assert sorted(q for b in encoder.batches for q in b["query"]) == sorted(f"q{k}" for k in range(200)) and set(encoder.batches[0]["positive"][:40]) == {f"p{k}" for k in range(40)}
    kept = [x for b in classifier.batches for x in b["label"]]
    assert 150 < len(kept) < 200 and set(kept) == {0, 1}


def test_accuracy_and_guards(spark):
    from tesserae.operators import training

    rows = spark.createDataFrame([(1, 1), (0, 1), (1, None), (0, 0)], "label int, prediction int")
    assert tuple(training.accuracy(rows).first()) == (4, 0.5) and tuple(training.accuracy(rows.limit(0)).first()) == (0, None)
    assert training.enough(rows, 4) and not training.enough(rows, 5)
    ids = training.corpus_ids(spark.createDataFrame([(5, "b"), (1, "a"), (2, "b"), (3, None)], "position int, positive string"))
    assert {r["position"]: r["corpus_id"] for r in ids.collect()} == {1: 0, 2: 1, 5: 1, 3: None}


def test_saved_classifier(spark, tmp_path):
    rows = spark.createDataFrame([("red rose", 0), ("blue sky", 1)] * 10, "text string, label int")
    path = str(tmp_path / "model")
    other = rows.select("text").distinct()
    assert models.load_classifier(spark, path) is None and models.tuned_or_base(spark, path, lambda p: "tuned", lambda: "base") == "base"
    assert {r["category"] for r in models.predicted_category(other, None, F.lit("rule")).collect()} == {"rule"}
    models.save_classifier(models.train_text_classifier(rows), ["flower", "air"], path)
    models.save_classifier(models.train_text_classifier(rows), ["flower", "air"], path)
    got = models.predicted_category(other, models.load_classifier(spark, path), F.lit("rule"))
    assert {r["text"]: r["category"] for r in got.collect()} == {"red rose": "flower", "blue sky": "air"}
    assert models.tuned_or_base(spark, path, lambda p: p, lambda: "base") == path


def test_tokenized(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 99)], "i int, text string")
    got = {r["i"]: r for r in models.tokenized(rows, length=8).collect()}
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) == 8 and "text" not in r.asDict() for r in got.values())
    assert [sum(got[i]["attention_mask"]) for i in (1, 2, 3)] == [4, 1, 8] and got[2]["input_ids"] == [1] + [0] * 7 and len(set(got[3]["input_ids"])) == 1


def test_monitor(spark, tmp_path):
    from tesserae.streaming import monitor

    src, seen, out, check = (str(tmp_path / n) for n in ("src", "seen", "out", "check"))
    run = lambda: monitor.monitor(spark, spark.readStream.schema("url string, date string").json(src), seen, out, check, baseline=2).awaitTermination()
    put = lambda rows: spark.createDataFrame(rows, "url string, date string").coalesce(1).write.mode("append").json(src)
    put([("a", "1"), ("b", "2"), ("c", "3")])
    run()
    assert sorted(r["url"] for r in spark.read.json(seen).collect()) == ["b", "c"]
    put([("c", "3"), ("d", "5"), ("d", "4")])
    run()
    put([("d", "6"), ("e", "7")])
    run()
    assert sorted((r["url"], r["date"]) for r in spark.read.json(out).collect()) == [("d", "4"), ("e", "7")]
    assert sorted(r["url"] for r in spark.read.json(seen).collect()) == ["b", "c", "d", "e"]


def test_work_goes_on_where_it_was_stopped(spark, tmp_path):
    from tesserae.streaming import monitor

    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for n in range(3):
        spark.createDataFrame([(f"{n}-{k}",) for k in range(4)], "url string").coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).json(src)
    ran = []

    def work(batch, epoch):
        ran.append(epoch)
        if len(ran) == 2:
            batch.limit(2).write.json(f"{out}/epoch={epoch}")  # half of it was written
            raise RuntimeError("stopped")
        return batch.withColumn("done", F.lit(True))

    with pytest.raises(Exception, match="stopped"):
        monitor.in_steps(stream, work, out, check).awaitTermination()
    monitor.in_steps(stream, work, out, check).awaitTermination()
    rows = spark.read.json(out).collect()
    assert len(rows) == len({r["url"] for r in rows}) == 12 and ran == [0, 1, 1, 2]


def test_one_prompt_fails_alone(spark):
    rows = spark.createDataFrame([("bad",), ("good",)], "p string").coalesce(1)
    got = {r["p"]: r["r"] for r in rows.select("p", models.ask(F.col("p"), standins.DigestModel("bad"), otherwise=lambda e: "none").alias("r")).collect()}
    assert got["bad"] == "none" and got["good"].startswith("Reply ")


def test_request_stamps(spark):
    rows = spark.range(3).select(T.request_stamp().alias("s"), T.elapsed(F.lit(125.9)).alias("e")).collect()
    assert len({r["s"]["id"] for r in rows}) == 3 and all(r["s"]["millis"] > 1_600_000_000_000 and r["e"] == "2 min 5 s" for r in rows)


def test_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Known:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    def getCheckpointDir(self):
                        return Known()

                return Sc()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="share"):
        order.shared_folder(Session())
