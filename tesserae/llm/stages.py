"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

A filter returns the columns of documents for the rows it keeps: doc_id, text, lang, source, n_chars; others are not
carried, whatever their names. Rows without a doc_id cannot be traced and go in the first stage. Nulls in lang, source and
n_chars are kept as they are. Whole texts are read, however long. Rows that repeat whole are judged alike, each by itself.
Empty tables pass through every stage.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import langid, minhash, packing, quality, suffix_dedup
from tesserae.llm.common import active, held_out, record_batch, slices, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a repeated passage at least.
PASSAGE = 100


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids."""
    return docs.join(ids, "doc_id", "left_semi").select(COLUMNS)


def _row_filter(docs: DataFrame, owner: str, judge) -> DataFrame:
    """Keeps the rows for whose texts judge gives True, where they are."""
    docs = docs.select(COLUMNS)

    def run(batches):
        active(owner)
        for part in slices(batches):
            yield part.filter(pa.array(judge(part.column(1).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: without a letter (null and empty texts, too), or with two languages about as likely. Ties between languages are rejected."""
    texts = tuple(sorted(langid.dictionaries(docs, ~held_out()).items()))
    return _row_filter(docs.filter("doc_id is not null"), "language", lambda rows: [langid.classify(t, langid._compressors(texts))[2] for t in rows])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of quality is under 0.7; 0.7 itself stays. Null and empty texts have the probability of their measures."""
    model = quality.fit_on_tables(docs, table(spark, sf_dir, "labels"), ~held_out())
    sent = spark.sparkContext.broadcast(pickle.dumps(model))  # each task has its own model and cache, and drops them
    held: dict = {}

    def judge(rows):
        if "model" not in held:
            held["model"] = pickle.loads(sent.value)
        return held["model"].score(rows) >= 0.7

    return _row_filter(docs, "quality", judge)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates: five-word shingles, 80 % in common. Texts without a word are no duplicates of each other; rows that repeat whole have one id, and all stay. Rows without an id go."""
    groups = minhash.near_duplicates(docs, words=5, percent=80)
    return _keep(docs, groups.filter("doc_id = component_id").select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 100 bytes and more that stand in an earlier document or place; documents of which nothing is left go.

    Removal keeps to whole characters: a character of which a part is left stays. n_chars becomes the length of a text that
    was cut. Null and empty texts stay as they are, and rows without an id, in which nothing is looked for.
    """
    docs = docs.select(COLUMNS)
    found = suffix_dedup.repeated_places(docs, PASSAGE, carry=("lang", "source", "n_chars")).select("doc_id", "text", "carried.*", "places")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        active("suffix cut")
        for part in slices(batches):
            rows = []
            for doc_id, text, lang, source, n_chars, places in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if places:
                    text = without(text, [{"begin": a, "end": b} for a, b in suffix_dedup.covered(places, PASSAGE).tolist()])
                    n_chars = len(text)
                    if not text.strip():
                        continue
                rows.append((doc_id, text, lang, source, n_chars))
            if rows:
                yield record_batch(schema, *map(list, zip(*rows, strict=True)))

    cut = found.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
    return cut.unionByName(docs.filter("doc_id is null").withColumn("n_chars", F.col("n_chars").cast("long")))


def without(text: str, spans: list) -> str:
    """The text without byte spans, which are shortened to whole characters."""
    data, at, out = text.encode("utf-8", "replace"), 0, []
    for s in spans:
        begin, end = s["begin"], s["end"]
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:begin])
        at = end
    return b"".join([*out, data[at:]]).decode("utf-8")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens; a row per piece, with its ids. Null and empty texts are their end id alone; every row is packed, also repeated ones and those without an id."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
