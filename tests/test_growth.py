"""What queries do with much input: the same rows as plain versions, without rows, batches or tasks that grow with it."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import search

SF = "/root/testdata/sf0.001"


def test_nearest_in_buckets(spark):
    """The rows of Spark's join of buckets, and no row for each pair that shares one."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(9_000_001, None), (9_000_002, [float("nan")] * 64), (None, [0.5] * 64)], rows.schema)
    queries = rows.filter("vec_id % 50 = 0")
    got = search.nearest_in_buckets(rows.union(bad), queries.union(bad), 10, "vec_id", bucket=0.2, tables=3)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan
    vectors = rows.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.2, numHashTables=3, seed=7).fit(vectors)
    met = model.approxSimilarityJoin(vectors.filter("vec_id % 50 = 0"), vectors, float("inf"), distCol="d").select("datasetA.vec_id", F.col("datasetB.vec_id").alias("id"), "d").collect()
    want = {}
    for query, other, d in sorted(met, key=lambda r: (r[0], round(r[2] ** 2, 12), r[1])):
        if query != other and len(want.setdefault(query, [])) < 10:
            want[query].append((other, d))
    found = {}
    for r in got.orderBy("query_id", "distance", "id").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(np.allclose([d for _, d in found[q]], [d for _, d in want[q]]) for q in found)


def test_best_documents_by_words(spark):
    """The rows of bm25() that count, also for ids of several rows, null ids and texts, and ties; only they leave a task."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(7, "the first again"), (7, "the first again"), (9, None), (None, "the first"), (9_000_001, "the first again"), (9_000_002, "the first again"), (9_000_003, "")], docs.schema)
    docs = docs.union(odd)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    terms = search.query_terms(items.union(spark.createDataFrame([(9_999, "again first the the"), (9_998, ""), (9_997, "zzzzqqq")], items.schema)), "query_id", "text")
    also = docs.filter("doc_id % 40 = 3").crossJoin(items.filter("query_id < 3").select("query_id")).select("query_id", F.col("doc_id").alias("id")).union(spark.createDataFrame([(9_997, 3), (5_555, 3)], "query_id long, id long"))
    everything = {}
    for r in search.bm25(docs, terms).filter("id is not null").collect():
        everything.setdefault(r["query_id"], {})[r["id"]] = r["bm25"]
    named = {(r["query_id"], r["id"]) for r in also.collect()}
    want = {(q, i): s for q, rows in everything.items() for place, (i, s) in enumerate(sorted(rows.items(), key=lambda r: (-round(r[1], 9), r[0]))) if place < 6 or (q, i) in named}
    best = search.bm25_best(docs, terms, 6, also)
    got = {(r["query_id"], r["id"]): r["bm25"] for r in best.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(got) == best.count() and {9_000_001, 9_000_002, 7} <= {i for q, i in got if q == 9_999}
    assert search.bm25_best(docs.filter("false"), terms, 6, also).count() == 0


def test_in_ranges():
    """All rows in their order, in ranges of bounded size; a long row stands alone."""
    import pyarrow as pa

    from tesserae.functions.batches import in_ranges

    texts = ["x" * (2000 if k % 100 else 300_000) for k in range(1000)]
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": texts})
    cut = list(in_ranges([batch, batch.slice(0, 0), batch.slice(7, 1)], 100_000, 64))
    assert pa.Table.from_batches(cut).column("k").to_pylist() == [*range(1000), 7]
    assert all(c.num_rows <= 64 and (c.nbytes <= 100_000 or c.num_rows == 1) for c in cut) and len(cut) < 120


def test_tokenized_a_few_at_a_time(spark):
    from tesserae.operators import models

    class FewTexts:
        """A tokenizer that takes 64 texts at once."""

        def load(self):
            def run(texts):
                assert len(texts) <= 64
                return [list(range(len(t or ""))) for t in texts]

            return run

    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), (F.col("id") % 11).cast("int"))).alias("text")).coalesce(1)
    got = models.tokenized(rows, FewTexts(), length=5).orderBy("id").collect()
    n = [min(5, r["id"] % 11 if r["id"] % 7 else 0) for r in got]
    assert [r["input_ids"] for r in got] == [list(range(k)) + [0] * (5 - k) for k in n] and [sum(r["attention_mask"]) for r in got] == n


def test_batches_of_many_files(spark, tmp_path):
    """A batch of the monitor of q69 is as many files as its rows come from, and comes when the one before has been taken."""
    from tesserae.plans import stored

    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    folder = tmp_path / "arriving"
    counts = [len(list(folder.glob("*.parquet"))) for _ in stored._arriving(spark, str(tmp_path), str(folder))]
    assert len(counts) == 4 and counts[0] > 1 and counts[1] > counts[0]


def test_similar_rows_are_counted(spark):
    """Recall and MRR of rows with copies, ties and labels of one row against brute force."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(1)
    x[50:90] = x[:40]
    labels = [int(k) for k in rng.integers(0, 40, 300)]
    labels[7] = 1000
    rows = spark.createDataFrame([(k * 3 % 301, labels[k], x[k].tolist()) for k in range(300)], "vec_id long, label long, embedding array<double>")
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    s, ids, ranks = np.round(u @ u.T, 12), np.array([k * 3 % 301 for k in range(300)]), []
    for k in range(300):
        order = [j for j in np.lexsort([ids, -s[k]]) if j != k]
        ranks.append(next((p + 1 for p, j in enumerate(order) if labels[j] == labels[k]), None))
    got = {r["metric"]: r["value"] for r in search.retrieval_quality(rows, block=64).collect()}
    want = {f"Recall@{n}": round(sum(r is not None and r <= n for r in ranks) / 300, 4) for n in (1, 3, 5, 10)}
    assert got == {**want, "MRR": round(sum(1 / r for r in ranks if r) / 300, 4)}


def test_rows_are_not_shuffled_for_meetings(spark, monkeypatch):
    """Rows of blocks that meet are packed once, a row a block; they are not dealt to every block of the others. Vectors of other lengths, null labels and ids of several rows keep their meaning."""
    rng = np.random.default_rng(4)
    rows = [(k, k % 5 if k % 11 else None, rng.normal(size=8 if k % 3 else 6).tolist()) for k in range(400)]
    table = spark.createDataFrame([*rows, (None, 1, [1.0] * 8), (900, 1, None), (901, 1, [None] * 8)], "vec_id long, label long, embedding array<double>")
    plans, met = [], search._met
    monkeypatch.setattr(search, "_met", lambda *a: plans.append(met(*a)) or plans[-1])
    got = {r["metric"]: r["value"] for r in search.retrieval_quality(table, block=32).collect()}
    assert len(plans) == 2 and all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() and "CartesianProduct" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    ranks = []
    for k, label, v in rows:
        others = [(-round(float(np.dot(v, w) / ((np.linalg.norm(v) + 1e-9) * (np.linalg.norm(w) + 1e-9))), 12), j, m) for j, m, w in rows if j != k and len(w) == len(v)]
        ranks.append(next((p + 1 for p, (_, _, m) in enumerate(sorted(others, key=lambda x: x[:2])) if label is not None and m == label), None))
    want = {f"Recall@{n}": round(sum(r is not None and r <= n for r in ranks) / 400, 4) for n in (1, 3, 5, 10)}
    assert got == {**want, "MRR": round(sum(1 / r for r in ranks if r) / 400, 4)}


def test_bags_of_arrow_tokens():
    """Tokens held as Arrow, also as parts of batches, make the same bags as lists of numbers."""
    import pyarrow as pa

    from tesserae.operators import contrastive

    tokens = [[3, 3, 1], [], [0], [4, 4, 4]]
    want = np.log1p([[0, 1, 0, 2, 0], [0] * 5, [1, 0, 0, 0, 0], [0, 0, 0, 0, 3]])
    column = pa.array([[2], *tokens, [1]], pa.list_(pa.int32())).slice(1, 4)
    assert (contrastive._bags(tokens, 5) == want).all() and (contrastive._bags(column, 5) == want).all()
    assert contrastive._bags([], 5).shape == (0, 5)


def test_documents_of_the_lexical_index(spark, tmp_path):
    """A document is one row of the index with its counts, not a row for each of its terms."""
    from tesserae.operators.lexical import LexicalIndex

    index = LexicalIndex(spark, f"file://{tmp_path}/index", block=2, buckets=3)
    index.upsert(spark.createDataFrame([(1, "a b a c"), (2, None), (3, "c"), (3, "d d")], "doc_id long, text string"))
    got = {r["id"]: (r["length"], dict(zip(r["terms"].split(), r["tfs"], strict=True))) for r in index.tables.read("documents").collect()}
    assert index.tables.read("documents").count() == 3 and got == {1: (4, {"a": 2, "b": 1, "c": 1}), 2: (0, {}), 3: (2, {"d": 2})}


def test_postings_of_whole_blocks(monkeypatch):
    """However documents are cut into batches and ranges, a term has one row of a block, with all its documents and those pairs that none beats."""
    import pyarrow as pa

    from tesserae.operators import lexical

    monkeypatch.setattr(lexical, "RANGE", 300)
    rng = np.random.default_rng(5)
    docs = []
    for k in range(120):
        counts = {f"t{x}": int(rng.integers(1, 4)) for x in np.unique(rng.zipf(1.6, 6) % 30)} if k % 9 else {}
        docs.append({"block": k // 5, "id": k, "length": int(rng.integers(1, 9)), "terms": " ".join(counts), "tfs": list(counts.values())})
    rows = pa.RecordBatch.from_pylist(docs, pa.schema([("block", pa.int64()), ("id", pa.int64()), ("length", pa.int32()), ("terms", pa.string()), ("tfs", pa.list_(pa.int32()))]))
    packed = list(lexical._packed_postings(rows.slice(k, 7) for k in range(0, 120, 7)))
    assert len(packed) > 5
    dealt = [pa.RecordBatch.from_arrays([pa.array([1] * b.num_rows, pa.int32()), *b.columns], names=["bucket", "term", "entries"]) for b in packed]
    got = pa.Table.from_batches(list(lexical._postings(dealt))).to_pylist()
    want = {}
    for d in docs:
        for term, tf in zip(d["terms"].split(), d["tfs"], strict=True):
            want.setdefault((term, d["block"]), []).append((d["id"], tf, d["length"]))
    assert len(got) == len(want) and {(r["term"], r["block"]) for r in got} == want.keys()
    for r in got:
        of = want[r["term"], r["block"]]
        assert r["bucket"] == 1 and r["n"] == len(of) and sorted(map(tuple, (e.values() for e in r["entries"]))) == of
        peaks = {(t, n) for _, t, n in of if not any(u >= t and m <= n and (u, m) != (t, n) for _, u, m in of)}
        assert sorted((p["tf"], p["length"]) for p in r["peaks"]) == sorted(peaks)


def test_postings_deal_texts(spark):
    """The texts are dealt by their ids, and what is counted of them is not dealt again; rows of one id and length are counted together."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c c"), (1, "d"), (2, None), (None, "e e")], "doc_id long, text string")
    got = search.postings(docs)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    executed = got._jdf.queryExecution().executedPlan().toString()
    assert "explode" in plan and executed.count("Exchange hashpartitioning(") == executed.count("Exchange hashpartitioning(id#") == 1
    want = [(1, 1, "", 1), (1, 1, "d", 1), (1, 3, "", 2), (1, 3, "a", 3), (1, 3, "b", 1), (1, 3, "c", 2), (2, 0, "", 1), (None, 2, "", 1), (None, 2, "e", 2)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_partitions_are_written_once(spark, tmp_path):
    """What replaces partitions, made of them, is written once: the files that are moved, and nothing that stays beside."""
    from tesserae.sources import files

    index = files.BucketedIndex(spark, f"file://{tmp_path}/index", "doc_id long, text string", "doc_id", 4)
    index.upsert(spark.range(100).selectExpr("id as doc_id", "'old' as text"))
    written, write = [], files.checkpointed
    files.checkpointed = lambda df: written.append(df.columns) or write(df)
    try:
        index.upsert(spark.range(50, 120).selectExpr("id as doc_id", "'new' as text"))
        index.remove(spark.range(0, 120, 7).selectExpr("id as doc_id"))
    finally:
        files.checkpointed = write
    assert written == [["doc_id", "text", "bucket"], ["doc_id", "bucket"]]  # the records and the keys only
    assert {r["doc_id"]: r["text"] for r in index.rows().collect()} == {k: "new" if k >= 50 else "old" for k in range(120) if k % 7}
    assert {p.name for p in (tmp_path / "index").iterdir() if p.is_dir()} == {f"bucket={k}" for k in range(4)}


def test_postings_are_brought_to_their_blocks_once(spark, tmp_path, monkeypatch):
    """All levels of a search read the same table of postings, and find what scoring everything finds."""
    from tesserae.operators import lexical

    index = lexical.LexicalIndex(spark, f"file://{tmp_path}/index", block=2, buckets=2)
    index.upsert(spark.createDataFrame([(k, " ".join(f"w{k * j % 13}" for j in range(1, 9))) for k in range(120)], "doc_id long, text string"))
    queries = spark.createDataFrame([(1, "w3 w5 w7 w0"), (2, "w11 w2 none")], "query_id long, text string")
    made, write = [], lexical.checkpointed
    monkeypatch.setattr(lexical, "checkpointed", lambda df: made.append(set(df.columns)) or write(df))
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in index.top_k(queries, 4, first=2).collect()}
    assert sum({"entries", "level"} <= columns for columns in made) == 1
    every = index.scores(index.weights(search.query_terms(queries, "query_id", "text"))).collect()
    for q in (1, 2):
        want = sorted(((-round(r["score"], 9), r["id"]) for r in every if r["query_id"] == q))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, -s) for s, i in want]


def test_postings_are_packed(spark, tmp_path):
    """A term has a row for each range of blocks, not for each block; blocks of two versions with one number stay apart."""
    from tesserae.operators.lexical import LexicalIndex

    index = LexicalIndex(spark, f"file://{tmp_path}/index", block=2, buckets=2)
    docs = [(k, f"w w{k % 3} w{k % 5}") for k in range(200)]
    for some in (docs[:100], docs[100:]):
        index.upsert(spark.createDataFrame(some, "doc_id long, text string"))
    held = index.tables.read("postings").filter("term = 'w'")
    assert held.count() <= 2 * 2 * 4 and held.agg(F.sum("n")).first()[0] == 200  # of each version and of each of the session's partitions one for the last block and one for those before
    queries = spark.createDataFrame([(1, "w1 w4"), (2, "w w2 none")], "query_id long, text string")
    terms = search.query_terms(queries, "query_id", "text")
    want = {(r["query_id"], r["id"]): r["bm25"] for r in search.bm25(spark.createDataFrame(docs, "doc_id long, text string"), terms).collect()}
    got = {(r["query_id"], r["id"]): r["score"] for r in index.scores(index.weights(terms)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_searches_of_kept_indexes_move_no_scores(spark, tmp_path, monkeypatch):
    """What a search in both kept indexes writes on its way is a row for each group of blocks, and the best and the named documents of each task; not a row for each query, block and term. Queries are taken a few at a time where they have many terms."""
    from tesserae.operators import lexical
    from tesserae.operators.vector_index import VectorIndex

    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in rng.zipf(1.3, 20) % 50)) for k in range(1500)], "doc_id long, text string")
    vectors = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(0, 1500, 2)], "vec_id long, embedding array<double>")
    queries = docs.filter("doc_id % 100 = 0").join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("query_id"), "text", "embedding")
    index, cells = lexical.LexicalIndex(spark, f"file://{tmp_path}/index", buckets=2), VectorIndex(spark, f"file://{tmp_path}/cells")
    index.upsert(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "w1 w2 soon replaced").otherwise(F.col("text"))))
    index.upsert(docs.filter("doc_id % 3 = 0"))
    cells.build(vectors, cells=4)
    made, write = [], lexical.checkpointed
    monkeypatch.setattr(lexical, "checkpointed", lambda df: made.append(write(df)) or made[-1])
    want = search.multi_query_search(docs, vectors, queries)
    for most in (lexical.MOST_TERMS, 60):
        monkeypatch.setattr(lexical, "MOST_TERMS", most)
        made.clear()
        got = lexical.indexed_search(index, cells, queries).collect()
        assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in got) == sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in want.collect())
        assert all(df.count() < 1500 for df in made) and (most > 60) == (sum("entries" in df.columns for df in made) == 1)
