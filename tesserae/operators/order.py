"""Positions in a total order, without sorting everything in one task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The path of a new folder, which is not made yet, in the one the session names for checkpoints, which all executors share; in a temporary one only where it names none and everything runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{removed_at_exit(spark, f"{base.rstrip('/')}/{uuid.uuid4().hex}")}/data"


def removed_at_exit(spark: SparkSession, folder: str) -> str:
    """Makes a folder for intermediate tables, which the file system removes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: made once, and lost with no executor."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Adds the row's place (from 0) in the order of these columns: ranges are sorted each by itself, and their sizes added up."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_local", local).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_local") - 1).drop("_part", "_local", "_before")


def before_stop(df: DataFrame, stop, *order: str) -> DataFrame:
    """The rows before the first one, in this order, for which ``stop`` holds: one minimum, no running window."""
    key = F.struct(*order)
    first = df.agg(F.min(F.when(stop, key)).alias("_first"))
    return df.join(F.broadcast(first), F.col("_first").isNull() | (key < F.col("_first"))).drop("_first")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in this order, by a partial aggregation."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(df.columns)


def round_robin(df: DataFrame, group: str, ordinal: str, batch: int = 64) -> DataFrame:
    """Deals the rows of equal ``group`` apart: first all first ones, then all second ones; adds rn, position and batch.

    Groups are numbered in range partitions, so a frequent group lies in several; what a group has in earlier partitions is
    known from the few groups that go on in a next one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, group, ordinal).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min(ordinal).alias("_least"))
    edges = sizes.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(F.col(group).asc_nulls_first()))).withColumn("_groups", F.count("*").over(Window.partitionBy("_part")))
    # the first and the last group of each partition, at most two rows for each; only these can go on
    edges = edges.filter("_place = 1 or _place = _groups").select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_n", "_least")
    of_group = Window.partitionBy("_g").orderBy("_p")
    edges = edges.select("_g", "_p", F.coalesce(F.sum("_n").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.min("_least").over(Window.partitionBy("_g")).alias("_from"))
    local = Window.partitionBy("_part", group)
    dealt = ranged.withColumn("_rn", F.row_number().over(local.orderBy(ordinal))).withColumn("_own", F.min(ordinal).over(local))
    dealt = dealt.join(F.broadcast(edges), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    dealt = dealt.withColumn("rn", (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("int")).withColumn("_first", F.coalesce("_from", "_own"))
    dealt = dealt.select(*df.columns, "rn", "_first")
    return with_position(dealt, "rn", "_first").drop("_first").withColumn("batch", F.floor(F.col("position") / batch))


def first_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Adds is_first: whether a row is the first turn of its conversation, by a partial aggregation."""
    first = turns.groupBy(conversation).agg(F.min(turn).alias("_first"))
    return turns.join(first, conversation, "left").withColumn("is_first", F.coalesce(F.col(turn) == F.col("_first"), F.lit(False))).select(*turns.columns, "is_first")


def hashed_split(df: DataFrame, key: str, share: float = 0.1, least: int = 50, seed: str = "42") -> DataFrame:
    """Adds split: 'eval' for the first max(least, share) rows in the order of a hash of the key, else 'train'."""
    n = df.count()
    placed = with_position(df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))), "_h", key)
    return placed.withColumn("split", F.when(F.col("position") < max(least, int(n * share)), "eval").otherwise("train")).drop("_h", "position")


def first_rows_split(df: DataFrame, *order: str, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """(train, eval) as some trainers do it: the first n rows evaluate and all rows train, so the evaluation has been seen. Prefer the other splits."""
    return df, df.orderBy(*order).limit(n)


def stratified_split(df: DataFrame, label: str, key: str, percent: int = 10, seed: str = "42") -> DataFrame:
    """Adds split by a hash of the key, so that each label gives about the same share and no label is sorted as a whole."""
    share = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}-"), F.col(label).cast("string"))), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(share < percent, "eval").otherwise("train"))
