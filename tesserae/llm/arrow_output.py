"""Operator 7: token ids in Arrow stream files of fixed-size lists, and their reader.

The documents go out in ascending doc_id order as one stream of ids, an end id after each. The stream is cut into shards
by doc_id, one per shuffle partition, and each shard into sequences of equal length; the last one of a shard is padded,
and its mask is false there. A shard is two files: ``ids-*.arrow`` with ``ids: fixed_size_list<uint16>[n]`` and ``mask:
fixed_size_list<bool>[n]`` in batches of an equal number of sequences, and ``docs-*.arrow`` with the place of each
document. Memory-mapped, a sequence is a slice of the file without a copy.

Texts are encoded where they are read; only the 16-bit ids are shuffled, each row straight to its shard. Shard bounds are
approximate quantiles of doc_id, as many as there are shards. Files are written under another name and then renamed, so
a task that runs again replaces its own files.

Null text counts as empty: the document is its end id alone. Null doc_ids come first. Repeated rows are documents of their
own, ties ordered by their ids. Texts are encoded whole; a row of ids is as long as its text. Empty tables give no shard and no row; other columns are not carried.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import tokens
from tesserae.llm.common import active, ensure_dir, filesystem, record_batch, shuffle_partitions, slices

PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
CODED = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
MANIFEST = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _File:
    """A stream file that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.fs, path = filesystem(folder)
        self.final, self.now = f"{path}/{name}", f"{path}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.now)
        self.writer = pa.ipc.new_stream(self.out, schema)

    def close(self) -> None:
        self.writer.close()
        self.out.close()
        self.fs.move(self.now, self.final)


def _write_shard(folder: str, shard: int, rows, length: int, per_batch: int) -> tuple[int, int]:
    """rows: (doc_id, ids) in order. Returns the documents and tokens written."""
    schema = _schema(length)
    ids_file, docs_file = _File(folder, f"ids-{shard:06d}.arrow", schema), _File(folder, f"docs-{shard:06d}.arrow", PLACES)
    chunk, held, kept, places, at, docs = length * per_batch, [], 0, [], 0, 0

    def put(values: np.ndarray, real: int) -> None:
        mask = np.arange(len(values)) < real
        ids_file.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(values), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

    def put_places() -> None:
        docs_file.writer.write_batch(record_batch(PLACES, *map(list, zip(*places, strict=True))))

    for doc, ids in rows:
        values = np.frombuffer(ids, dtype="<u2")
        places.append((doc, at, len(values)))
        at, docs = at + len(values), docs + 1
        held.append(values)
        kept += len(values)
        if kept >= chunk:
            values = np.concatenate(held)
            for k in range(0, len(values) - chunk + 1, chunk):
                put(values[k : k + chunk], chunk)
            held = [values[len(values) // chunk * chunk :].copy()]
            kept = len(held[0])
        if len(places) >= 8192:
            put_places()
            places = []
    if kept:
        values = np.concatenate(held)
        padded = np.zeros(-(-kept // length) * length, dtype=np.uint16)
        padded[:kept] = values
        put(padded, kept)
    if places:
        put_places()
    ids_file.close()
    docs_file.close()
    return docs, at


def write_sequences(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, length: int = 2048, per_batch: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest (shard, n_docs, n_tokens), which has a row per shard."""
    ensure_dir(folder)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    shards = shuffle_partitions(docs.sparkSession)
    quantiles = [k / shards for k in range(1, shards)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, 100 * shards).alias("q")).first()["q"] if quantiles else []
    bounds = np.array(bounds or [], dtype=np.int64)
    end = np.array([end_id], dtype="<u2").tobytes()

    def encode(batches):
        active("token files")
        coder = tokens.word_level(vocabulary)
        for part in slices(batches):
            doc = part.column(0)
            shard = np.searchsorted(bounds, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            yield record_batch(CODED, pa.array(shard), doc, [x + end for x in coder.many(part.column(1))])

    def write(batches):
        shard = None

        def rows():
            nonlocal shard
            for batch in batches:
                if batch.num_rows:
                    shard = batch.column(0)[0].as_py()
                    yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

        ahead = rows()
        first = next(ahead, None)
        if first is None:
            return

        def all_rows():
            yield first
            yield from ahead

        n_docs, n_tokens = _write_shard(folder, shard, all_rows(), length, per_batch)
        yield record_batch(MANIFEST, [shard], [n_docs], [n_tokens])

    coded = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    placed = coded.repartitionById(shards, F.coalesce("shard", F.lit(0))).sortWithinPartitions("doc_id", "ids")
    return placed.mapInArrow(write, "shard int, n_docs long, n_tokens long")


class Shard:
    """Memory-mapped access to one shard."""

    def __init__(self, folder: str, shard: int):
        fs, path = filesystem(folder)
        name = f"{path}/ids-{shard:06d}.arrow"
        self._source = pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(self._source))
        with fs.open_input_stream(f"{path}/docs-{shard:06d}.arrow") as source:
            self.places = pa.ipc.open_stream(source).read_all()
        self.length = self.batches[0].schema.field("ids").type.list_size
        self.chunk = self.batches[0].num_rows * self.length
        self._values = [b.column(0).values.to_numpy() for b in self.batches]

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of the shard's k-th sequence, slices of the file."""
        b, row = divmod(k, self.batches[0].num_rows)
        return tuple(self.batches[b].column(c).slice(row, 1).flatten() for c in (0, 1))

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids from a place in the shard's stream; without a copy where one batch holds them."""
        first, last = start // self.chunk, (start + n - 1) // self.chunk
        parts = [self._values[b][max(0, start - b * self.chunk) : start + n - b * self.chunk] for b in range(first, last + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """doc_id, start in the whole stream and ids (binary, little-endian unsigned 32-bit), from the files. ``manifest``: the collected rows of write_sequences, one per shard."""
    base, shards = 0, []
    for row in sorted(manifest, key=lambda r: r["shard"]):
        shards.append((row["shard"], base))
        base += row["n_tokens"]

    def run(batches):
        for batch in batches:
            for number, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(folder, number)
                for places in shard.places.to_batches(max_chunksize=2048):
                    doc, start, n = (places.column(k) for k in range(3))
                    ids = [shard.tokens(s, k).astype("<u4").tobytes() for s, k in zip(start.to_pylist(), n.to_pylist(), strict=True)]
                    yield record_batch(READ, doc, pa.array(start.to_numpy() + at), ids)

    return spark.createDataFrame(shards, "shard int, base long").mapInArrow(run, "doc_id long, start long, ids binary")
