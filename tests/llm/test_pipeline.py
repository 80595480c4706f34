"""The corpus pipeline's stages, each on what the one before kept, against plain versions of what it should do."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import langid, minhash, quality, stages
from tesserae.llm.common import held_out

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def library_ids(text):
    if not hasattr(library_ids, "encode"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        tokenizer.encode_special_tokens = True
        library_ids.encode = tokenizer.encode
    return [*library_ids.encode(text or "", add_special_tokens=False).ids, 0]


def components(texts, words, percent):
    sets = {i: set(minhash.shingles(t, words).tolist()) for i, t in texts.items()}
    name, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and name[i] != name[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    return name


def without_repeats(texts, length=100):
    """What is left of each text of the strings that start earlier, whole characters staying."""
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        cover = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                cover[s : s + length] = True
            seen.add(data[s : s + length])
        at, spans = 0, []
        while at < len(data):
            end = at
            while end < len(data) and cover[end]:
                end += 1
            if end > at:
                spans.append({"begin": at, "end": end})
            at = end + 1
        out[i] = stages.without(texts[i], spans)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        given = {r["doc_id"]: r["text"] for r in before.collect()}
        if name != "packing":
            assert after.columns == docs.columns
            rows = after.collect()
            kept[name] = {r["doc_id"]: r["text"] for r in rows}
            assert len(rows) == len(kept[name])
        if name == "language":
            coders = langid._compressors(tuple(sorted(langid.dictionaries(before, ~held_out()).items())))
            assert kept[name] == {i: t for i, t in given.items() if langid.classify(t, coders)[2]}
        elif name == "quality":
            model = quality.fit_on_tables(before, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out())
            scores = dict(zip(given, model.score(list(given.values())), strict=True))
            assert kept[name] == {i: t for i, t in given.items() if scores[i] >= 0.7} and len(kept[name]) < len(given)
        elif name == "near_duplicates":
            of = components(given, 5, 80)
            assert kept[name] == {i: t for i, t in given.items() if of[i] == i} and len(kept[name]) < len(given)
        elif name == "repeated_passages":
            want = without_repeats(given)
            assert kept[name] == {i: t for i, t in want.items() if t.strip() or t == given[i]} and kept[name] != given
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != given[r["doc_id"]])
        else:
            pieces, sequences = {}, {}
            for r in after.collect():
                pieces.setdefault(r["doc_id"], []).append(r)
                sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert pieces.keys() == given.keys()
            for i, of in pieces.items():
                of.sort(key=lambda r: r["start"])
                ids = np.concatenate([np.frombuffer(bytes(r["ids"]), dtype="<u4") for r in of]).tolist()
                assert ids == library_ids(given[i]) and [r["start"] for r in of] == [0, *np.cumsum([r["length"] for r in of])[:-1]]
            for of in sequences.values():
                at = 0
                for offset, length in sorted(of):
                    assert offset == at
                    at += length
                assert at == 1024 or at < 1024 and at & (at - 1) == 0
        before = after


PROSE = "The quick house of the river was there, and all of them went home when the other one had come to see it. "
ROWS = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n", "en", None, 2), (4, "12 34 !!", "en", "s", 8), (5, PROSE * 3, "en", "s", 1), (6, PROSE * 3, None, "s", 1), (7, PROSE * 3, "en", "s", 1),
    (8, "x" * 300_000, "en", "s", 1), (9, (PROSE + "And so on. ") * 4000, "en", "s", 1), (10, "é" * 500 + PROSE, "en", "s", 1), (11, "word", "en", "s", 4), (None, PROSE, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, a row that repeats, and columns of other names."""
    rows = spark.createDataFrame([*ROWS, ROWS[4]], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", F.lit("clash").alias("label"), F.lit(1).alias("spans"), F.lit(0.5).alias("score")).repartition(3)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_rows(spark, odd, name):
    """Every stage gives what its docstring says of them."""
    rows = STAGES[name](spark, odd, SF).collect()
    ids = [r["doc_id"] for r in rows]
    if name == "packing":
        assert sum(r["length"] for r in rows) == sum(len(library_ids(t)) for _, t, *_ in [*ROWS, ROWS[4]])
        return
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    if name == "language":
        assert None not in ids and not {1, 2, 3, 4} & set(ids) and {5, 6, 7, 9} <= set(ids) and ids.count(5) == 2
    elif name == "quality":
        assert all(r["text"] for r in rows) or {1, 2} & set(ids)
    elif name == "near_duplicates":
        assert sorted(ids) == [1, 2, 3, 4, 5, 5, 8, 9, 10, 11]
    else:
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert texts[1] is None and texts[2] == "" and texts[3] == " \n" and None in ids and 6 not in ids and 7 not in ids
        want = without_repeats({i: t for i, t, *_ in ROWS if i and t})
        assert {i: t for i, t in texts.items() if i and i > 3} == {i: t for i, t in want.items() if i > 3 and t} and texts[8] == "x" and ids.count(5) == 2


@pytest.mark.parametrize("name", STAGES)
def test_stages_without_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    assert STAGES[name](spark, docs, SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {r["doc_id"]: r["doc_tokens"] for r in rows} and len(total) > 50
