"""Repeated rows, columns with clashing names and very long texts, for the operators whose other tests have none of them."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tesserae.llm import ann, arrow_output, bpe, html, tokens, topk
from tesserae.llm.common import shared_dir

LONG = "Very long texts, of many thousand words: été 12 !!\n" * 20_000
CLASHING = "ids string, decoded int, start string, n_tokens string, shard int, tokens string"
CLASH = ("x", 1, "y", "z", 7, "w")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(5, "one"), (5, "one"), (5, "another"), (None, "no id"), (None, None), (6, LONG), (7, LONG), (1, "")]
    return rows, spark.createDataFrame([(*r, *CLASH) for r in rows], "doc_id long, text string, " + CLASHING).repartition(3)


def test_bpe(docs):
    rows, df = docs
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(((r["doc_id"], digest(bytes(r["ids"])), digest(bytes(r["decoded"]))) for r in bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=repr)
    assert got == sorted(((i, digest(codec.encode(t)), digest((t or "").encode())) for i, t in rows), key=repr)


def test_token_files(spark, docs):
    rows, df = docs
    path, folder = P.path("word_bpe_49k.json"), shared_dir(spark)
    manifest = arrow_output.write_sequences(df, folder, path).collect()
    got = sorted(arrow_output.read_documents(spark, folder, manifest).collect(), key=lambda r: r["start"])
    encode = tokens.word_level(path)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(np.append(np.frombuffer(encode(t), "<u2").astype("<u4"), np.uint32(2)).astype("<u4").tobytes())
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at, found = 0, {}
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
        found.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}


def test_searches(spark):
    """Rows of one id are candidates each, and one query together."""
    rows = [(0, [1.0, 0.5]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "c", 1, 1.0, 5, 6) for r in rows], "vec_id long, embedding array<double>, id string, rank int, score double, query_id int, block int")

    def want(transform):
        out = []
        for q in (0, 50):
            pairs = sorted((-float(np.dot(transform(a), transform(b))), j) for i, a in rows if i == q for j, b in rows if j != q)
            out += [(q, k + 1, j, -s) for k, (s, j) in enumerate(pairs[:3])]
        return out

    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 50 == 0, k=3, scale=2.0).collect())) == want(lambda v: np.floor(2 * np.array(v)))
    assert sorted(map(tuple, ann.nearest(df, F.col("id") % 50 == 0, k=3).collect())) == want(np.array)


def test_pages(spark):
    shared = "<p>y one two three four five six seven</p>"
    rows = [(1, "http://a/1", "<article>x</article>"), (1, "http://a/1", "<article>x</article>"), (1, "http://a/2", shared), (2, "http://a/3", shared + "<p>own</p>"), (None, "http://a/4", shared + "<p>alone</p>"), (3, "http://b/5", f"<article>{LONG}</article>")]
    df = spark.createDataFrame([(*r, "t", 1, "m", "b") for r in rows], "page_id long, url string, html string, text string, host int, main string, blocks string")
    got = sorted(map(tuple, html.main_text(df).collect()), key=repr)
    plain = "y one two three four five six seven"
    assert got == sorted([(1, "http://a/1", "x"), (1, "http://a/1", "x"), (1, "http://a/2", ""), (2, "http://a/3", "own"), (None, "http://a/4", f"{plain} alone"), (3, "http://b/5", " ".join(LONG.split()))], key=repr)
