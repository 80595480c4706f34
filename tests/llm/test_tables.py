"""The training-data operators on small awkward tables, against brute force: nulls, empty texts, ties, repeats, clashing names."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tesserae.llm import ann, arrow_output, bpe, html, langid, minhash, packing, quality, queries, suffix_dedup, topk
from tesserae.llm.common import held_out, shared_dir

SF = "/root/testdata/sf0.001"
PASSAGE = "A passage that several of these documents share, long enough to be found by every operator that looks for it; it goes on. "
TEXTS = [None, "", " ", "word", PASSAGE, PASSAGE, "Start. " + PASSAGE + "End one.", "Other. " + PASSAGE + "End two.", "é" * 400, "é" * 400 + "x", "one two", "ONE TWO", PASSAGE * 3, "12 !!", "\n".join(f"Line {i} of it" for i in range(300))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "clash", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, start int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def test_bpe(docs, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    codec = bpe.codec(path, P.PATTERN)
    for r in bpe.encode_decode(docs, path, P.PATTERN).collect():
        assert bytes(r["ids"]) == codec.encode(TEXTS[r["doc_id"]]) and bytes(r["decoded"]) == (TEXTS[r["doc_id"]] or "").encode()
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0


def test_packing(docs, empty):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, P.PATTERN).collect()
    joined = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        joined[r["doc_id"]] = joined.get(r["doc_id"], b"") + bytes(r["ids"])
        assert len(r["ids"]) == 4 * r["length"]
    assert {d: len(x) // 4 for d, x in joined.items()} == {r["doc_id"]: r["doc_tokens"] for r in rows} and len(joined) == len(TEXTS)
    assert packing.pack_documents(empty, path, P.PATTERN).count() == 0


def test_token_files(spark, docs, empty):
    path, folder = P.path("word_bpe_49k.json"), shared_dir(spark)
    manifest = arrow_output.write_sequences(docs, folder, path, length=64, per_batch=2).collect()
    got = arrow_output.read_documents(spark, folder, manifest).orderBy("doc_id").collect()
    from tesserae.llm.tokens import word_level

    at = 0
    for r, t in zip(got, TEXTS, strict=True):
        want = np.append(np.frombuffer(word_level(path)(t), "<u2").astype("<u4"), np.uint32(2)).astype("<u4")
        assert r["start"] == at and bytes(r["ids"]) == want.tobytes()
        at += len(want)
    shard = arrow_output.Shard(folder, manifest[0]["shard"])
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 64 and ids.to_numpy()[0] == shard.tokens(0, 1)[0]
    other = shared_dir(spark)
    none = arrow_output.write_sequences(empty, other, path).collect()
    assert arrow_output.read_documents(spark, other, none).count() == 0


def brute_cover(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        cover = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                cover[s : s + length] = True
            seen.add(data[s : s + length])
        out[i] = bytes(b for b, c in zip(data, cover, strict=True) if not c)
    return out


def test_suffix_dedup(spark, docs, empty):
    want = brute_cover(list(enumerate(TEXTS)), 100)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == want and len(got) == len(TEXTS)
    twice = suffix_dedup.remove_repeats(docs.union(docs)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in twice} == want and len(twice) == 2 * len(TEXTS)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    nulls = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert suffix_dedup.remove_repeats(nulls).count() == 0


def test_suffix_dedup_of_one_id_with_several_texts(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(4)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2] + texts[0][:150]), (2, texts[1]), (3, texts[2]), (4, texts[1] + texts[3])]
    got = sorted((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 300, 300), (2, 300, 300), (2, 300, 300), (2, 450, 300), (3, 300, 0), (4, 600, 300)]


@pytest.mark.parametrize("held", [1, 3, 20])
def test_suffix_dedup_of_a_frequent_anchor(spark, monkeypatch, held):
    """The same 40 bytes in many different surroundings, some of which repeat in part: more than a task holds, and in several ranges."""
    monkeypatch.setattr(suffix_dedup, "GROUP", held)
    rng = np.random.default_rng(held)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    lefts, rights, core = [noise(80) for _ in range(6)], [noise(80) for _ in range(6)], "0123456789012345678901234567890123456789"
    rows = []
    for k in range(200):
        text = ""
        for _ in range(3):
            left, right = lefts[rng.integers(6)] if rng.random() < 0.5 else noise(80), rights[rng.integers(6)] if rng.random() < 0.5 else noise(80)
            text += noise(20) + left + core + right
        rows.append((k, text))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute_cover(rows, 100)


@pytest.mark.parametrize("length", [28, 60, 141])
def test_suffix_dedup_lengths(spark, docs, length):
    got = suffix_dedup.remove_repeats(docs, length).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute_cover(list(enumerate(TEXTS)), length)


def test_suffix_dedup_refuses_other_lengths(docs):
    for length in (27, 142):
        with pytest.raises(ValueError, match="length"):
            suffix_dedup.remove_repeats(docs, length)


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = np.random.default_rng(1)
    body = "".join(rng.choice(list("abcdef "), 9000))
    rows = [(1, body + body[2000:2600]), (2, "x" * 50 + body[4000:4333] + "y" * 300), (3, body)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute_cover(rows, 100)


def brute_components(rows, words, percent):
    sets = {i: set(minhash.shingles(t, words).tolist()) for i, t in rows}
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and name[i] != name[j]:
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    return name


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80), (3, 50)])
def test_minhash(spark, words, percent):
    rng = np.random.default_rng(7)
    rows = list(enumerate(TEXTS))
    base = [f"w{rng.integers(900)}" for _ in range(150)]
    for k in range(60):  # a family of copies with few or many changes
        copy = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 12)):
            copy[at] = f"v{rng.integers(900)}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(300 + k, PASSAGE + f" own text number {k} " * 3) for k in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, words, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(minhash.shingles(t, words)) for i, t in rows}


def test_minhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    monkeypatch.setattr(minhash, "HUB_PART", 5)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(80):
        copy = list(base)[: int(rng.integers(90, 121))]
        for at in rng.integers(0, 90, rng.integers(0, 8)):
            copy[at] = f"v{rng.integers(900)}"
        rows.append((k, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 3, 85)


def test_minhash_few_common_coordinates(spark):
    words = [f"w6392x{k}" for k in range(24)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20]))]  # 16 of 20 shingles, but 10 of 24 coordinates in common
    a, b = (minhash.signature(minhash.shingles(t, 5)) for _, t in rows)
    assert (a == b).sum() == 10
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 5, 80) == {1: 1, 2: 1}


def test_minhash_of_a_shared_passage(spark, monkeypatch):
    """Documents that share a passage and no more are sent about as often as they have bands, however many they are; the linked ones among them are found."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    colliding = minhash._colliding
    sent = []

    def counted(percent):
        run, rows = colliding(percent), spark.sparkContext.accumulator(0)
        sent.append(rows)

        def go(batches):
            def seen():
                for batch in batches:
                    rows.add(batch.num_rows)
                    yield batch

            return run(seen())

        return go

    monkeypatch.setattr(minhash, "_colliding", counted)
    rows = [(k, " ".join([f"w{i}" for i in range(60)] + [f"d{k}x{i}" for i in range(60)])) for k in range(160)]
    rows += [(1000 + k, f"{rows[k][1]} more") for k in range(0, 160, 5)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 1000 for i, _ in rows}
    assert 0 < sum(a.value for a in sent) < 36 * len(rows)  # 36 bands


def test_minhash_without_rows(empty):
    assert minhash.near_duplicates(empty).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 3)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(30)]
    rows += [(400, None), (401, []), (402, [1.0] * 7 + [None]), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7), (405, [0.0] * 8), (406, [1e308] * 8), (450, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def _exact(rows, k, every, transform, zero):
    ok = [(i, transform(np.array(v, dtype=float))) for i, v in rows if v and None not in v and (np.abs(np.array(v, dtype=float)) < 1e150).all() and (zero or any(v))]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_exact_topk(vectors):
    rows, df = vectors
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 50 == 0).collect()))
    assert got == [(q, r, i, int(s)) for q, r, i, s in _exact(rows, 5, 50, lambda v: np.floor(256 * v), True)]
    assert topk.top_k(df.filter("vec_id < 0"), F.col("id") % 50 == 0).count() == 0
    few = topk.top_k(df.filter("vec_id < 3"), F.col("id") == 0).collect()
    assert len(few) == 2


def test_ann(vectors):
    rows, df = vectors
    got = ann.nearest(df, F.col("id") % 20 == 0, k=20).collect()
    want = {}
    for q, _, i, s in _exact(rows, 20, 20, lambda v: v, False):
        want.setdefault(q, {})[i] = s
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = sum(1 for q in want for i in want[q] if i in found[q])
    assert hit >= 0.9 * sum(map(len, want.values())) and found.keys() == want.keys()
    copies = {50, *range(300, 330)}  # equal vectors: equal scores, the smallest ids
    for q in found:
        same = {i: s for i, s in found[q].items() if i in copies}
        assert len(set(same.values())) <= 1 and sorted(same) == sorted(copies - {q})[: len(same)]
    assert ann.nearest(df.filter("vec_id < 0"), F.col("id") % 20 == 0).count() == 0


def test_ann_recall_on_the_table(spark):
    got = queries.op8_ann(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -9
        hit += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 0.9 * len(got) and len(got) == 20 * len(range(0, len(x), 20))


def test_language_and_quality_tables(docs, empty):
    texts = langid.dictionaries(docs, ~held_out())
    assert set(texts) == {"en"}
    got = langid.identify(docs, texts).collect()
    assert len(got) == len(TEXTS) and {r["lang_pred"] for r in got if not any(c.isalpha() for c in TEXTS[r["doc_id"]] or "")} == {"und"}
    assert langid.dictionaries(empty, ~held_out()) == {}
    assert langid.identify(empty, {}).count() == 0
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit_on_tables(docs, labels, ~held_out())
    scores = quality.score(docs, model).collect()
    eight = docs.filter("text is not null and doc_id < 9").limit(8)
    few = quality.fit_on_tables(eight, eight.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), F.lit(True))
    assert few.layers is not None and len({round(s, 6) for s in few.score([t for t in TEXTS[:9] if t])}) > 1
    assert quality.fit_on_tables(eight, labels.limit(0), F.lit(True)).score(["x"])[0] == 0.5
    assert len(scores) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.score(empty, model).count() == 0


def test_quality_measures_whole_texts(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 300, n))
    rows = [(k, prose(9000), 1) for k in range(24)] + [(100 + k, prose(int(rng.integers(900, 2000))), 1) for k in range(60)] + [(200 + k, "JUNK!! " * int(rng.integers(900, 9000)), 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit_on_tables(docs.drop("quality"), docs.drop("text"), F.col("doc_id") % 4 != 2)
    long = [t for _, t, _ in rows[:24]]
    assert all(len(t) > 30_000 and w in model.rows for t in long for w in quality.measures(quality._TOKEN.findall(t)))
    assert (model.score(long) >= 0.7).all() and (model.score([t for _, t, q in rows if q == 0]) < 0.7).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in queries.op9_language(spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.95


def test_pages(spark):
    menu = "<div>Home News Sport Weather Travel Food About</div>"
    rows = [(1, "http://a.b/1", f"{menu}<div>First page has text of its own</div>"), (2, "http://a.b/2", f"{menu}<p>Second page differs in every word</p>"), (3, "http://c.d/3", f"{menu}<p>Alone on its host</p>"), (4, None, None), (5, "http://a.b/5", f"{menu}<article>{menu}kept</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    home = "Home News Sport Weather Travel Food About"
    assert got == {1: "First page has text of its own", 2: "Second page differs in every word", 3: f"{home} Alone on its host", 4: "", 5: f"{home} kept"}
    assert html.main_text(df.filter("page_id < 0")).count() == 0


def test_pages_of_a_template(spark):
    """A notice that nearly all articles of a host have goes; what half of them have, or the few of a small host, or what is all of an article, stays."""
    notice, passage = "Sign up to read every story of this site first", "A passage that half of all the articles here have"
    page = lambda k: f"<p>{notice}</p><p>{f'{passage}' if k % 2 else 'Other words'} in story number {k}</p><p>{passage if k % 2 else k}</p>"
    rows = [(k, f"http://a.b/{k}", f"<article>{page(k)}</article>") for k in range(20)] + [(100 + k, f"http://c.d/{k}", f"<article>{page(k)}</article>") for k in range(4)]
    rows += [(200 + k, f"http://e.f/{k}", f"<article>{page(1)}</article>") for k in range(30)]  # copies of one text
    rows += [(300, "http://a.b/300", f"<article><p>{notice}</p></article>"), (301, "http://a.b/301", "<article>Short</article>"), (302, "http://a.b/302", "<article></article>")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    own = lambda k: f"{passage} in story number {k} {passage}" if k % 2 else f"Other words in story number {k} {k}"
    assert got == {k: own(k) for k in range(20)} | {100 + k: f"{notice} {own(k)}" for k in range(4)} | {200 + k: f"{notice} {own(1)}" for k in range(30)} | {300: notice, 301: "Short", 302: ""}


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())


def test_query_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_suffix_dedup(spark, SF).collect():
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode())
    kept = brute_cover(sorted(texts.items()), 100)
    assert {r["doc_id"]: r["kept_sha256"] for r in queries.op3_suffix_dedup(spark, SF).collect()} == {i: hashlib.sha256(b).hexdigest() for i, b in kept.items()}
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in queries.op2_byte_bpe(spark, SF).collect():
        ids = codec.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def _library(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files_query(spark):
    encode, at = _library("word_bpe_49k.json"), 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted(map(tuple, queries.op7_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want = []
    for i in sorted(texts):
        ids = np.array([*encode(texts[i]), 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_packing_query(spark):
    encode = _library("byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_packing(spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for i, of in pieces.items():
        ids, at = np.array([*encode(texts[i]), 0], dtype="<u4"), 0
        for r in sorted(of, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for of in sequences.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_bpe_query_against_tiktoken(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_byte_bpe(spark, SF).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]] or ""), dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())


def test_minhash_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_minhash(spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(sorted(texts.items()), 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(texts)


def test_pages_query(spark):
    """These pages keep their text in an article, whose tags can simply be taken out."""
    import html as references
    import re

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op10_html(spark, SF).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(references.unescape(re.sub(r"<[^>]*>", "\n", article)).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_pages_without_main(spark):
    """Hosts whose pages have no main element, mixed with pages that have one: what other pages of the host share goes, compared with every pair of pages."""
    import re

    rows = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = r["html"] if r["page_id"] % 5 == 0 else re.sub(r"</?article>", "", r["html"])
        rows += [(r["page_id"], f"http://h{r['page_id'] % 3}.org/{r['page_id']}", page), (10_000 + r["page_id"], f"http://h{r['page_id'] % 3}.org/other", page.replace("<p>", "<p>Second ", 1))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    streams = {}
    for i, url, page in rows:
        blocks = html.parse(page)
        main = [t for role, t in blocks if role == html.MAIN]
        streams[i] = (html.host(url), main, [(role, t) for role, b in blocks if role != html.MAIN for t in b.split(" ")])
    grams = {}
    for i, (host, _, tokens) in streams.items():
        for s in range(len(tokens) - html.TOKENS + 1):
            grams.setdefault((host, *(t for _, t in tokens[s : s + html.TOKENS])), set()).add(i)
    for i, (host, main, tokens) in streams.items():
        if main:
            assert got[i] == " ".join(main)
            continue
        covered = set()
        for s in range(len(tokens) - html.TOKENS + 1):
            if len(grams[(host, *(t for _, t in tokens[s : s + html.TOKENS]))]) > 1:
                covered.update(range(s, s + html.TOKENS))
        assert got[i] == " ".join(t for s, (role, t) in enumerate(tokens) if role == html.OTHER and s not in covered)


def test_language_of_one_word(spark):
    rows = [(1, "the cat and the dog went home", "en"), (3, "kuusi", "fi"), (4, "12 34", "xx"), (5, "kuusi", None), (6, "cat and dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = langid.dictionaries(docs, F.col("doc_id") < 5)
    assert texts.keys() == {"en", "fi"} and all(len(t) >= 8 for t in texts.values())
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, texts).collect()}
    assert got[5] == "fi" and got[6] == "en" and got[4] == "und"
