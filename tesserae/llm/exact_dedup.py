"""Exact duplicates of incoming batches against immutable snapshots, screened by static binary-fuse filters.

A snapshot keeps the distinct texts of one batch in exact buckets: a table bucketed by digest, which later batches join without shuffling
it. Over the digests that were new in the batch it has static filters, one for each cell of at most about
CELL digests: three places a digest, one byte each, built once and never changed. An incoming batch is first grouped by itself
(one text a digest and task is shuffled, however many copies there are). Then its digests are dealt to the cells of each snapshot: what
its filter does not know is new for certain, and only what it may know is joined with the exact bucket and compared byte
by byte. The home of a text is the first snapshot that has it, and rows of one home are one group.

Digests are not trusted: of equal digests the distinct texts are kept apart (as variants, numbered in the order of the
texts), and equal digests of two batches count only if their bytes are equal.

Nulls: a null text counts as empty; a null id is smaller than all others. Of equal texts the row with the largest id stays; of
repeated rows with that id exactly one. Empty tables give empty results. Very long texts are hashed and compared whole.
Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import shared_dir, shuffle_partitions, written

#: Digests of a filter.
CELL = 1 << 15
_FILTER = "cell int, seed long, segment int, table binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes: multiply and shift, as in the finaliser of MurmurHash3."""
    h = keys.astype(np.uint64) + np.uint64(seed)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, size: int) -> np.ndarray:
    """Three places of each hash, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(size - 2 * segment)) >> np.uint64(32)
    mask, step = np.uint64(segment - 1), np.uint64(segment)
    return np.stack([first, (first + step) ^ ((h >> np.uint64(18)) & mask), (first + step + step) ^ (h & mask)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def fuse(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment's length, table) of a static filter over 64-bit keys: places that only one key has left are peeled, round by round, and filled in backwards."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    size = (max(1, math.ceil(n * factor / segment) - 2) + 2) * segment
    for seed in range(1000):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        at, rounds, left = _places(h, segment, size), [], n
        count = np.bincount(at.ravel(), minlength=size)
        total = np.bincount(at.ravel(), weights=np.tile(np.arange(n), 3), minlength=size).astype(np.int64)
        lone = np.flatnonzero(count == 1)
        while len(lone):
            some, where = np.unique(total[lone], return_index=True)
            rounds.append((some, lone[where]))
            left -= len(some)
            gone = at[:, some]
            np.subtract.at(count, gone, 1)
            np.subtract.at(total, gone, some[None, :])
            touched = np.unique(gone)
            lone = touched[count[touched] == 1]
        if not left:
            table, prints = np.zeros(size, np.uint8), _prints(h)
            for some, own in reversed(rounds):
                table[own] = prints[some] ^ np.bitwise_xor.reduce(table[at[:, some]], axis=0)
            return seed, segment, table.tobytes()
        size += segment
    raise RuntimeError("no filter was found")


def may_hold(keys: np.ndarray, seed: int, segment: int, table: bytes) -> np.ndarray:
    """Whether the filter may hold these keys: always for its own, for one of 256 others."""
    h, held = _mixed(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % 2**64), np.frombuffer(table, np.uint8)
    return np.bitwise_xor.reduce(held[_places(h, segment, len(held))], axis=0) == _prints(h)


def _celled(digests: DataFrame, cells: int) -> DataFrame:
    return digests.select(F.pmod(F.hash("digest"), F.lit(cells)).alias("cell"), F.xxhash64("digest").alias("key"), "digest")


def _keys(table: pa.Table) -> np.ndarray:
    return table.column("key").to_numpy().view(np.uint64)


def filters(digests: DataFrame, cells: int) -> DataFrame:
    """A filter for each cell of the distinct digests."""
    schema = pa.schema([("cell", pa.int32()), ("seed", pa.int64()), ("segment", pa.int32()), ("table", pa.binary())])

    def build(group: pa.Table) -> pa.Table:
        seed, segment, table = fuse(_keys(group))
        return pa.table([[group.column("cell")[0].as_py()], [seed], [segment], [table]], schema=schema)

    return _celled(digests, cells).select("cell", "key").groupBy("cell").applyInArrow(build, _FILTER)


def screened(digests: DataFrame, held: DataFrame, cells: int) -> DataFrame:
    """The distinct digests that the filters may know."""
    schema = pa.schema([("digest", pa.binary())])

    def probe(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not (asked.num_rows and known.num_rows):
            return schema.empty_table()
        row = known.slice(0, 1).to_pylist()[0]
        ok = may_hold(_keys(asked), row["seed"], row["segment"], row["table"])
        return asked.select(["digest"]).filter(pa.array(ok)).cast(schema)

    return _celled(digests, cells).groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(probe, "digest binary")


@dataclass
class Snapshot:
    """texts: name of the bucketed table (digest, n, texts); filters over the digests that were new, in so many cells; rows (id, row, digest, variant); classes (digest, variant, top, size, home, home_variant)."""

    texts: str
    filters: DataFrame
    cells: int
    rows: DataFrame
    classes: DataFrame


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Snapshots:
    """Batches that came one after another. digest: a column of a text, binary; what is equal under ``normalise`` is equal."""

    def __init__(self, spark: SparkSession, folder: str | None = None, normalise=lambda text: text, digest=_sha256):
        self.spark, self.folder, self.normalise, self.digest = spark, folder or shared_dir(spark), normalise, digest
        self.held: list[Snapshot] = []

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
        """Makes a snapshot of the batch; the earlier ones are only read."""
        k, folder = len(self.held), f"{self.folder}/snapshot-{len(self.held)}"
        text = F.coalesce(self.normalise(F.col(text_col).cast("string")), F.lit(""))
        rows = batch.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("digest", self.digest(F.col("text")))
        # the texts of one digest: one, as long as digests do not collide
        texts = rows.groupBy("digest").agg(F.sort_array(F.collect_set("text")).alias("texts")).select("digest", F.size("texts").alias("n"), "texts")
        name = f"tesserae_{uuid.uuid4().hex}"
        buckets = shuffle_partitions(self.spark)  # as the groups are partitioned, so that each bucket is one file
        texts.write.bucketBy(buckets, "digest").sortBy("digest").option("path", f"{folder}/texts").option("compression", "zstd").saveAsTable(name)
        new = self.spark.table(name)
        collided = new.filter("n > 1")
        if collided.isEmpty():
            rows = rows.select("id", "digest", F.lit(0).alias("variant"))
        else:
            variants = collided.select("digest", F.posexplode("texts").alias("variant", "text"))
            rows = rows.join(variants, ["digest", "text"], "left").select("id", "digest", F.coalesce("variant", F.lit(0)).alias("variant"))
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), folder)
        classes = rows.groupBy("digest", "variant").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("size"))
        known = None
        for j, old in enumerate(self.held):
            maybe = screened(new.select("digest"), old.filters, old.cells)
            asked = new.join(maybe, "digest", "left_semi").select("digest", F.posexplode("texts").alias("variant", "text"))
            both = asked.join(self.spark.table(old.texts).select("digest", F.col("texts").alias("others")), "digest")
            same = both.withColumn("home_variant", (F.array_position("others", F.col("text")) - 1).cast("int")).filter("home_variant >= 0")
            same = same.select("digest", "variant", F.struct(F.lit(j).alias("home"), "home_variant").alias("home"))
            known = same if known is None else known.unionByName(same)
        if known is None:
            classes = classes.withColumn("home", F.lit(k)).withColumn("home_variant", F.col("variant"))
        else:
            known = known.groupBy("digest", "variant").agg(F.min("home").alias("known"))
            classes = classes.join(known, ["digest", "variant"], "left").withColumn("home", F.coalesce("known.home", F.lit(k))).withColumn("home_variant", F.coalesce("known.home_variant", "variant")).drop("known")
        classes = written(classes, folder)
        fresh = classes.filter(F.col("home") == k).select("digest").distinct()
        cells = max(1, -(-fresh.count() // CELL))
        self.held.append(Snapshot(name, written(filters(fresh, cells), folder), cells, rows, classes))
        return self.held[-1]

    def members(self) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) of every row of every batch."""
        rows = classes = None
        for k, s in enumerate(self.held):
            r, c = s.rows.withColumn("batch", F.lit(k)), s.classes.withColumn("batch", F.lit(k))
            rows, classes = (r, c) if rows is None else (rows.unionByName(r), classes.unionByName(c))
        home = ["digest", "home", "home_variant"]
        top = F.max(F.struct(F.col("top.id").alias("id"), "batch", F.col("top.row").alias("row"))).alias("_top")
        groups = classes.groupBy(*home).agg(top, F.sum("size").alias("group_size"))
        known = classes.select(*home, "batch", "variant").join(groups, home).select("digest", "batch", "variant", "_top", "group_size")
        kept = (F.col("batch") == F.col("_top.batch")) & (F.col("row") == F.col("_top.row"))
        return rows.join(known, ["digest", "batch", "variant"]).select("id", F.col("_top.id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def exact_duplicates(rows: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Members of a table that is taken in as so many batches, by a hash of the id; see Snapshots."""
    store, dealt = Snapshots(rows.sparkSession, **how), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches))
    for k in range(batches):
        store.add(rows.filter(dealt == k), id_col, text_col)
    return store.members()
