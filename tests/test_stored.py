"""Indexes that are kept between runs, monitors and crawls: upserts against rebuilds, pruning, and runs that are stopped."""

import glob
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import rules, search
from tesserae.operators.lexical import LexicalIndex
from tesserae.operators.vector_index import VectorIndex, centres_of
from tesserae.sources import files
from tesserae.sources.stored import Versions
from tesserae.streaming import monitor

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
WORDS = [f"w{k}" for k in range(60)]


def texts(n, seed=0, start=0):
    rng = random.Random(seed)
    return [(start + i, " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(n)]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


# versions


def test_versions(spark, path):
    tables = Versions(spark, path, {"t": "a long, p int"})
    rows = lambda *v: spark.createDataFrame([(x, x % 2) for x in v], "a long, p int")
    assert tables.committed() == [] and tables.read("t").count() == 0
    tables.write(0, "t", rows(1, 2), "p")
    assert tables.read("t").count() == 0  # not committed yet
    tables.write(tables.next(), "t", rows(1, 2, 3), "p")
    tables.commit(0)
    tables.write(1, "t", rows(4), "p")
    tables.commit(1)
    assert sorted((r["a"], r["version"]) for r in tables.read("t").collect()) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    tables.write(2, "t", rows(9), "p")
    tables.commit(2, base=True)
    assert tables.committed() == [2] and tables.next() == 3 and [r["a"] for r in tables.read("t").collect()] == [9]
    tables.clean()
    assert not glob.glob(f"{path[7:]}/t/version=1*") and [r["a"] for r in tables.read("t").collect()] == [9]


# lexical index


def brute_top(spark, docs, queries, k):
    scored = search.bm25(docs, search.query_terms(queries, "query_id", "text")).collect()
    out = {}
    for r in scored:
        out.setdefault(r["query_id"], []).append((-round(r["bm25"], 9), r["id"]))
    return {q: sorted(found)[:k] for q, found in out.items()}


def found_top(index, queries, k, **how):
    out = {}
    for r in index.top_k(queries, k, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["id"]))
    return out


def state(index):
    counts = {r["term"]: (r["df"], r["total"]) for r in index.terms().collect()}
    return counts, {r["df"]: r["terms"] for r in index.frequencies().collect()}


def assert_same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-8)


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(0, "w0 w3 w3"), (1, "w40 w41 unknown"), (2, "w50"), (3, "unknown"), (4, ""), (5, None), (6, " ".join(WORDS))], "query_id long, text string")


def test_lexical_index_after_upserts(spark, path, queries):
    """Statistics and results after upserts, a removal and a rewrite are those of a new index; every change is seen at once."""
    index = LexicalIndex(spark, path, block=4, buckets=3)
    now = dict(texts(120))
    index.upsert(spark.createDataFrame(list(now.items()), DOCS))
    changes = [texts(40, 1, 100), [r for r in texts(15, 2, 3) if r[0] > 8] + [(5, None), (6, ""), (7, "w0 " * 30), (None, "w1"), (8, "w2")]]
    for change in changes:
        now |= {i: t for i, t in change if i is not None}
        index.upsert(spark.createDataFrame(change, DOCS))
    fresh = LexicalIndex(spark, path + "-new", block=4)
    fresh.upsert(spark.createDataFrame(list(now.items()), DOCS))
    assert state(index) == state(fresh)
    docs = spark.createDataFrame(list(now.items()), DOCS)
    assert_same(found_top(index, queries, 5, first=2), brute_top(spark, docs, queries, 5))

    index.remove(spark.createDataFrame([(7,), (100,), (999,)], "doc_id long"))
    now = {i: t for i, t in now.items() if i not in (7, 100)}
    docs = spark.createDataFrame(list(now.items()), DOCS)
    before = state(index)
    index.compact()
    assert index.tables.committed() == [4] and state(index) == before
    assert_same(found_top(index, queries, 3, first=1), brute_top(spark, docs, queries, 3))


def test_stopped_upsert_counts_for_nothing(spark, path, queries, monkeypatch):
    index = LexicalIndex(spark, path)
    index.upsert(spark.createDataFrame(texts(50), DOCS))
    before = state(index)
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.upsert(spark.createDataFrame(texts(50, 9), DOCS))
    assert state(index) == before
    index.upsert(spark.createDataFrame(texts(50, 9), DOCS))
    fresh = LexicalIndex(spark, path + "-new")
    fresh.upsert(spark.createDataFrame(texts(50, 9), DOCS))
    assert state(index) == state(fresh)


def test_blocks_are_skipped(spark, path):
    """Documents of one kind lie together, so most blocks are never scored, and the result is the same."""
    rows = [(i, f"kind{i // 50} " * (1 + i % 3) + f"w{i % 7}") for i in range(1000)]
    docs = spark.createDataFrame([(i, t, i // 50) for i, t in rows], DOCS + ", kind int")
    index = LexicalIndex(spark, path, order=("kind",), block=8)
    index.upsert(docs)
    queries, read = spark.createDataFrame([(0, "kind3 w5"), (1, "kind9 kind10")], "query_id long, text string"), []
    got = found_top(index, queries, 5, first=4, read=read)
    assert_same(got, brute_top(spark, docs, queries, 5))
    assert read[0][0] < 0.6 * read[0][1]


def test_bounds_hold(spark, path, queries):
    index = LexicalIndex(spark, path, block=8)
    index.upsert(spark.createDataFrame(texts(200, 4), DOCS))
    weights = index.weights(search.query_terms(queries, "query_id", "text"))
    bounds = {tuple(r)[:2]: r["bound"] for r in index.peaks(weights).groupBy("query_id", "block").agg(F.sum("best").alias("bound")).collect()}
    block = {r["id"]: r["block"] for r in index.tables.read("documents").select("id", "block").distinct().collect()}
    scores = index.scores(weights).collect()
    assert len(scores) > 200 and all(r["score"] <= bounds[r["query_id"], block[r["id"]]] + 1e-9 for r in scores)


def test_empty_lexical_index(spark, path, queries):
    index = LexicalIndex(spark, path)
    assert index.top_k(queries, 5).count() == 0 and index.size() == (0, 0.0)
    index.upsert(spark.createDataFrame([], DOCS))
    assert index.top_k(queries, 5).count() == 0
    index.upsert(spark.createDataFrame([(1, None, "x")], DOCS + ", term string"))
    assert index.size() == (1, 0.0) and index.top_k(queries, 5).count() == 0


def test_queries_read_the_buckets_of_their_terms(spark, path):
    index = LexicalIndex(spark, path)
    index.upsert(spark.createDataFrame(texts(100), DOCS))
    one = spark.createDataFrame([(0, "w1", 1)], "query_id long, term string, times long")
    plan = index.terms(one)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)


# vector index


def vectors(n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(10, dim))
    return [(i, (middle[i % 10] + 0.2 * rng.normal(size=dim)).astype(float).tolist()) for i in range(n)]


VECTORS = "vec_id long, embedding array<double>"


def test_centres():
    x = np.array([v for _, v in vectors()])
    centres = centres_of(x, 10)
    assert centres.shape == (10, 8) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert len({int(i) for i in (x[:10] @ centres.T).argmax(1)}) >= 8
    assert centres_of(np.ones((5, 3)), 4).shape == (1, 3) and centres_of(np.zeros((0, 3)), 4).shape == (0, 3)


def nearest_of(rows, query, k, leave=None):
    q, out = np.array(query), []
    for i, v in rows:
        v = np.array(v)
        norm = np.linalg.norm(q) * np.linalg.norm(v)
        if i != leave:
            out.append((-round(float(q @ v / norm), 9) if norm else 0.0, i))
    return [i for _, i in sorted(out)[:k]]


def test_vector_index(spark, path):
    rows = vectors()
    odd = [(None, [1.0] * 8), (1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1003, [1.0] * 3), (1004, [0.0] * 8)]
    index = VectorIndex(spark, path)
    index.build(spark.createDataFrame([(*r, 1) for r in rows + odd], VECTORS + ", cell int"), cells=10)
    assert index.rows().count() == 401 and len(index.centres()) == 10
    queries, read = spark.createDataFrame(rows[:40], VECTORS), []
    kept = rows + [(1004, [0.0] * 8)]
    got = {}
    for r in index.search(queries, 5, 10, "vec_id", same=False, read=read).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: nearest_of(kept, v, 5, i) for i, v in rows[:40]} and read[0][0] == read[0][1] == 40 * 401
    few, read = index.search(queries, 5, 3, "vec_id", same=False, read=read).collect(), read[1:]
    hits = sum(r["id"] in got[r["query_id"]] for r in few)
    assert hits >= 0.9 * 200
    one = []
    index.search(queries.limit(1), 5, 2, "vec_id", read=one)
    assert one[0][2] < 0.5 * one[0][3]  # rows of two cells are read


def test_vector_upsert_rewrites_the_cells_it_touches(spark, path):
    rows = vectors()
    index = VectorIndex(spark, path)
    index.build(spark.createDataFrame(rows, VECTORS), cells=10)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path[7:]}/cells/cell=*/part-*")}
    moved = [(0, rows[1][1]), (5000, rows[2][1])]
    touched = index.upsert(spark.createDataFrame(moved, VECTORS))
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path[7:]}/cells/cell=*/part-*")}
    cell = lambda f: int(f.split("cell=")[1].split("/")[0])
    assert 1 <= len(touched) <= 3
    assert {f: t for f, t in before.items() if cell(f) not in touched} == {f: t for f, t in after.items() if cell(f) not in touched}
    now = dict(rows) | dict(moved)
    got = [r["id"] for r in index.search(spark.createDataFrame([(0, rows[1][1])], "query_id long, embedding array<double>"), 7, 10).orderBy("rank").collect()]
    assert got == nearest_of(now.items(), rows[1][1], 7) and index.rows().count() == 401


def test_vector_index_of_one_hot_cell(spark, path, monkeypatch):
    """A cell that holds most rows is dealt out."""
    import tesserae.operators.vector_index as module

    monkeypatch.setattr(module, "ROWS", 50)
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300 + i, [0.0, 1.0 + i]) for i in range(20)]
    index = VectorIndex(spark, path)
    index.build(spark.createDataFrame(rows, VECTORS), cells=2)
    got = index.search(spark.createDataFrame([(7, [1.0, 0.1])], VECTORS), 3, 1, "vec_id", same=False).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2]
    empty = VectorIndex(spark, path + "-empty")
    empty.build(spark.createDataFrame([], VECTORS))
    assert empty.search(spark.createDataFrame(rows[:2], VECTORS), 3, 4, "vec_id").count() == 0


# indexes in buckets


def test_upsert_in_place(spark, path):
    index = files.BucketedIndex(spark, path, "doc_id string, text string", buckets=8)
    assert index.rows().count() == 0
    index.upsert(spark.createDataFrame([(f"d{i}", "old") for i in range(100)], "doc_id string, text string"))
    before = {f: os.stat(f).st_ino for f in glob.glob(f"{path[7:]}/bucket=*/part-*")}
    changed = spark.createDataFrame([("d1", "new 1", 0), ("d1", "new 2", 1), ("more", "m", 0)], "doc_id string, text string, at int")
    touched = index.upsert(changed, ordinal="at")
    after = {f: os.stat(f).st_ino for f in glob.glob(f"{path[7:]}/bucket=*/part-*")}
    of = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert 1 <= len(touched) <= 2 and {of(f) for f in before} == set(range(8))
    assert {f: i for f, i in before.items() if of(f) not in touched} == {f: i for f, i in after.items() if of(f) not in touched}
    got = {r["doc_id"]: r["text"] for r in index.rows().collect()}
    assert got == {f"d{i}": "old" for i in range(100)} | {"d1": "new 2", "more": "m"}
    assert index.remove(spark.createDataFrame([("d5",), ("none",)], "doc_id string"))
    assert index.rows().filter("doc_id = 'd5'").count() == 0 and index.rows().count() == 100
    assert index.upsert(spark.createDataFrame([], "doc_id string, text string")) == []
    index.upsert(spark.createDataFrame([(None, "null key")], "doc_id string, text string"))
    assert index.rows().filter("doc_id is null").count() == 1
    index.remove(index.rows().select("doc_id").filter("doc_id is not null"))
    assert [r["text"] for r in index.rows().collect()] == ["null key"]


def test_co_located_joins_do_not_shuffle(spark, tmp_path):
    a = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    b = spark.range(500, 1500).select("id", (F.col("id") % 5).alias("y"))
    files.write_co_located(a, f"file://{tmp_path}/a", "id", 4)
    left = files.open_co_located(spark, f"file://{tmp_path}/a", "id long, x long", "id", 4)
    right = files.write_co_located(b, f"file://{tmp_path}/b", "id", 4)
    for how in ("inner", "left_anti", "left_semi", "full"):
        joined = left.hint("merge").join(right, "id", how)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == {"inner": 500, "left_anti": 500, "left_semi": 500, "full": 1500}[how]


# streams

NOTICE = "title string, url string, date string, body string"
RULES = rules.Rules({"The": "articles"}, {"k": ["key"], "b": ["bo"]})


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, NOTICE).coalesce(1).write.mode("append").parquet(folder)


def records(index):
    return sorted((r["url"], r["title"], r["category"], r["epoch"]) for r in index.rows().collect())


def test_index_new_survives_a_stop(spark, tmp_path):
    """A monitor that is killed after it has put rows in, and before its batch counts, ends as one that was never stopped."""
    got = {}
    for name in ("whole", "stopped"):
        folder, at = f"file://{tmp_path}/{name}/in", f"file://{tmp_path}/{name}"
        os.makedirs(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", 1).parquet(folder)
        index = monitor.monitored_index(spark, f"{at}/index", 4)
        arrive(spark, folder, [("The one", "u1", "1", "x"), ("key", "u2", "2", None), ("later", "u1", "3", "y"), ("none", None, "1", "z")])
        arrive(spark, folder, [("again", "u1", "4", "x"), ("plain", "u3", "5", "a book"), ("plain", "u4", "6", "")])
        arrive(spark, folder, [("plain", "u5", "7", ""), ("plain", "u3", "8", "")])
        seen = []

        def after(new, epoch, name=name, seen=seen):
            seen.append((epoch, sorted(r["url"] for r in new.collect())))
            if name == "stopped" and epoch == 1 and len(seen) == 2:
                raise RuntimeError("killed")

        for _ in range(2):
            try:
                monitor.index_new(stream, index, RULES, f"{at}/checkpoint", after=after).awaitTermination()
            except Exception as error:
                assert "killed" in str(error)
        got[name] = records(index)
        assert seen == [(0, ["u1", "u2"]), (1, ["u3", "u4"]), *([(1, ["u3", "u4"])] if name == "stopped" else []), (2, ["u5"])]
    assert got["whole"] == got["stopped"] == [("u1", "The one", "articles", 0), ("u2", "key", "k", 0), ("u3", "plain", "b", 1), ("u4", "plain", "other", 1), ("u5", "plain", "other", 2)]


def test_crawl_goes_on_where_it_was(spark, tmp_path):
    rows = [(p, k, f"u{p}-{k}" if (p, k) != (3, 1) else "u1-1", None if (p, k) == (2, 0) else f"{2030 - p}-01-0{k + 1}") for p in range(1, 8) for k in range(4)]
    schema, out = "page long, position long, url string, date string", {}
    for name in ("whole", "stopped"):
        at = f"file://{tmp_path}/{name}"
        os.makedirs(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        crawl = lambda at=at, stream=stream: monitor.crawl_on(stream, f"{at}/out", f"{at}/state", f"{at}/checkpoint", "2027").awaitTermination()
        for p in range(1, 8):
            spark.createDataFrame([r for r in rows if r[0] == p], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
            if name == "stopped" and p in (2, 4, 5):
                crawl()
        crawl()
        crawl()
        out[name] = sorted((r["url"], r["date"]) for r in spark.read.schema("url string, date string, epoch long").json(f"{at}/out").collect())
    assert out["whole"] == out["stopped"] == sorted((u, d) for p, k, u, d in rows if p <= 3 and (p, k) != (3, 1))


# many keywords


def test_many_keywords(spark):
    """The automaton gives what keyword after keyword gives: overlaps, an empty keyword, prefixes, nulls."""
    rng = random.Random(3)
    some = {f"c{k}": ["".join(rng.choices("abc é", k=rng.randint(1, 4))) for _ in range(3)] for k in range(300)}
    docs = spark.createDataFrame([(i, None if i % 17 == 0 else "".join(rng.choices("abcdefé XYZ", k=rng.randint(0, 12))), None if i % 13 == 0 else "".join(rng.choices("abcdé ", k=rng.randint(0, 30)))) for i in range(300)], "id long, title string, body string")
    for r in (rules.Rules({"a": "p1", "ab": "p2", "X": "p3"}, some), rules.Rules({"ab": "p2", "a": "p1", "": "all"}, some), rules.Rules({}, {"x": ["zz"], "empty": [""], "late": ["a"]}), rules.Rules({}, {"none": []}, "other"), rules.Rules()):
        both = docs.select(rules.infer_category(r, "title", "body").alias("a"), rules.infer_category_at_once(r, "title", "body").alias("b"), rules.infer_category(r, "title").alias("c"), rules.infer_category_at_once(r, "title").alias("d")).collect()
        assert all(x["a"] == x["b"] and x["c"] == x["d"] for x in both)


# trainers, table functions, counters


def halves(n=240):
    rng = random.Random(1)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(24)]
    return [(i, " ".join(rng.choices(topics[i % 24], k=6)), " ".join(rng.choices(topics[i % 24], k=6)), i // 24) for i in range(n)]


def test_halves_of_whole_texts(spark, tmp_path, monkeypatch):
    """The encoder of q74 is trained on all words of its documents, however long they are, and the halves that are held out are whole, too."""
    from tesserae.plans import stored

    whole = {k: " ".join(f"d{k}w{j}" for j in range(10 + 97 * k % 1000)) for k in range(80)}
    spark.createDataFrame(list(whole.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    trained, train, encoded, encode = [], stored.contrastive.train, [], stored.contrastive.encode
    monkeypatch.setattr(stored.contrastive, "train", lambda pairs, *a: trained.extend(pairs.collect()) or train(pairs, *a))
    monkeypatch.setattr(stored.contrastive, "encode", lambda text, weights: encoded.append(text) or encode(text, weights))
    row = stored.q74_contrastive(spark, str(tmp_path)).first()
    assert trained and row["held_out"] == len(whole) - len(trained) and set(encoded) == {"query", "positive"}
    for r in trained:
        words = whole[r["doc_id"]].split()
        assert r["query"].split() == words[: len(words) // 2] and r["positive"].split() == words[len(words) // 2 :]


def test_contrastive_encoder(spark, tmp_path):
    """The loss falls, any dealing of the batches gives the same model, and unseen halves find their topic more often."""
    from tesserae.operators import contrastive

    rows, shape = halves(), contrastive.Shape(features=512, size=16, rounds=20)
    table = spark.createDataFrame([r[1:] for r in rows] + [(None, "x", 0)], "query string, positive string, batch int")
    models = []
    for tasks, some in ((1, table), (3, table.repartition(4)), (2, table.orderBy("positive"))):
        losses = [r["loss"] for r in contrastive.train(some, f"file://{tmp_path}/m{tasks}", shape, tasks).orderBy("round").collect()]
        assert len(losses) == 21 and losses[-1] < 0.6 * losses[0] and losses[0] > losses[5]
        models.append(contrastive.load(spark, f"file://{tmp_path}/m{tasks}"))
    assert all(np.allclose(m, models[0], atol=1e-9) for m in models)
    unseen = spark.createDataFrame([(q, p) for _, q, p, _ in halves(300)[240:288]], "q string, p string")

    def hits(weights):
        got = unseen.select(contrastive.encode("q", weights).alias("q"), contrastive.encode("p", weights).alias("p")).collect()
        s = np.array([r["q"] for r in got]) @ np.array([r["p"] for r in got]).T
        return (s.argmax(1) % 24 == np.arange(48) % 24).sum()

    assert hits(models[0]) > hits(contrastive.start(shape)) and hits(models[0]) >= 40
    assert contrastive.train(table.limit(0), f"file://{tmp_path}/none", shape, 2).count() == 0


def test_gradient():
    from tesserae.operators import contrastive

    shape = contrastive.Shape(features=20, size=4)
    rng = np.random.default_rng(0)
    q, p = ([rng.integers(0, 20, 5).tolist() for _ in range(6)] for _ in range(2))
    w = contrastive.start(shape)
    loss, slope = contrastive.gradient(w, q, p, shape)
    for i, j in ((0, 0), (7, 2), (19, 3)):
        moved = w.copy()
        moved[i, j] += 1e-6
        assert abs((contrastive.gradient(moved, q, p, shape)[0] - loss) / 1e-6 - slope[i, j]) < 1e-4


def test_trainers_take_tables(spark, tmp_path):
    from tesserae.operators import contrastive, models, training

    notices = spark.createDataFrame([(f"t{k}", "even words" if k % 2 else "odd things", "a" if k % 2 else "b") for k in range(100)], "title string, body string, category string")
    pairs = spark.createDataFrame([(q, p) for _, q, p, _ in halves(48)], "query string, positive string")
    done = training.finetune_all(notices, pairs, ["a", "b"], contrastive.ContrastiveTrainer(contrastive.Shape(features=64, size=4, rounds=2), 2), training.TextTrainer(["a", "b"], 256), f"file://{tmp_path}")
    assert done == {"embedding": "trained", "classifier": "trained"}
    assert contrastive.load(spark, f"file://{tmp_path}/embedding").shape == (64, 4)
    found = models.predicted_category(notices.select("category", F.concat_ws(" ", "title", "body").alias("text")).withColumnRenamed("category", "want"), models.load_classifier(spark, f"file://{tmp_path}/classifier"), F.lit("other"))
    assert found.filter("want = category").count() == 100


def test_seed_pairs(spark):
    from tesserae.operators import qa

    notices = spark.createDataFrame([(1, "T", "x" * 301), (2, None, "y" * 301), (3, "short", "z"), (4, "none", None)], "notice_id long, title string, body string")
    made = qa.seed_pairs(notices, lambda title, body: [(f"q{k} {title}", body[:2], "well", body[:1]) for k in range(2 if title else 0)])
    assert sorted(tuple(r) for r in made.collect()) == [(1, "T", "q0 T", "xx", "well", "x"), (1, "T", "q1 T", "xx", "well", "x")]
    name = qa.seed_table(spark, lambda title, body: [(title, body, "user", None)], "seeds_for_test")
    assert spark.sql(f"SELECT * FROM {name}('a', 'b')").collect()[0]["question"] == "a"


def test_counts_on_the_way(spark, tmp_path):
    from tesserae.sources import pages

    items = spark.createDataFrame([("a", "x"), ("b", " "), ("c", None), ("d", "y"), ("d", "z")], "url string, body string")
    done = spark.createDataFrame([("a",), ("a",), ("z",)], "url string")
    counts = pages.counted_crawl(items, done, lambda rows: rows.write.parquet(f"file://{tmp_path}/out"))
    assert counts == {"new": 4, "skipped": 1, "empty": 2} == pages.crawl_counts(items, done).first().asDict()
    assert sorted(r["url"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["b", "c", "d", "d"]
    assert pages.counted_crawl(items.limit(0), done, lambda rows: rows.write.format("noop").mode("overwrite").save()) == {"new": 0, "skipped": 0, "empty": 0}


def test_intermediate_folders_go_with_the_application(tmp_path):
    """What queries leave in the shared folder is removed when the application ends."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, "/root/repo")
from tesserae.plans.session import session
import __spark_entry__ as entry
spark = session("t", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.ui.showConsoleProgress": "false"}})
for name in ("q16_upsert_index", "q18_positional_join"):
    assert entry.queries()[name](spark, "{SF}").count()
import glob; print("left", len(glob.glob("{tmp_path}/shared/*")))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "left 0" not in out.stdout and "left" in out.stdout, out.stderr[-500:]
    assert not [f for f in glob.glob(f"{tmp_path}/shared/*") if glob.glob(f"{f}/**/*.parquet", recursive=True)]


# a remote service


@pytest.fixture
def service():
    """A local OCR service: says the size of the picture; every first request of a size is turned away, and black pictures are refused."""
    import json
    import struct
    import threading
    import zlib
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            edge = self.headers["Content-Type"].split("boundary=")[1].encode()
            message, content = (p.split(b"\r\n\r\n", 1)[1][:-2] for p in body.split(b"--" + edge)[1:3])
            width, height = struct.unpack(">II", content[16:24])
            size = struct.unpack(">I", content[33:37])[0]
            black = not any(zlib.decompress(content[41 : 41 + size]))
            seen.append((self.headers["X-OCR-SECRET"], json.loads(message)["version"], width, height))
            code = 400 if black else 429 if seen.count(seen[-1]) == 1 else 200
            self.send_response(code)
            self.send_header("Retry-After", "0")
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"images": [{"fields": [{"inferText": f"{width}x{height}"}, {"inferText": " "}, {}]}]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_remote_ocr(spark, service):
    from tesserae.operators.remote_ocr import RemoteOcr
    from tesserae.plans import standins
    from tesserae.sources import pages

    url, seen = service
    engine = RemoteOcr(url, "secret", standins.PlainEngine(), wait=0.01)
    assert engine.read(np.full((40, 120, 3), 7, np.uint8), "jpg") == ["120x40"] and engine.read(np.full((41, 120), 7, np.uint8), "jpg") == ["120x41"]
    assert [s[:2] for s in seen] == [("secret", "V2")] * 4
    with pytest.raises(Exception, match="400"):
        engine.read(np.zeros((40, 120), np.uint8), "jpg")
    with pytest.raises(RuntimeError):
        RemoteOcr(url, "", standins.PlainEngine())
    with pytest.raises(Exception, match="refused"):
        RemoteOcr("http://127.0.0.1:9/", "k", standins.PlainEngine(), wait=0.0).read(np.ones((2, 2), np.uint8), "png")
    files = spark.createDataFrame([("a.png", b"P5 300 200 255\n" + bytes(range(200)) * 300), ("b.png", b"broken"), ("c.png", b"P5 20 20 255\n" + b"x" * 400)], "path string, content binary")
    got = {r["path"]: r["text"] for r in pages.recognised(files, engine).collect()}
    assert set(got) == {"a.png"} and "x" in got["a.png"]
