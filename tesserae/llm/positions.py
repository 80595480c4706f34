"""Places of rows in the order of their tree, without sorting a tree in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import shuffle_partitions, written


def placed(rows: DataFrame, folder: str, *order: str) -> DataFrame:
    """Adds pos (from 0, in the order of these columns, nulls first) and n (rows) within the row's ``tree``, a column without nulls.

    Rows are sorted in ranges of (tree, order), so a tree that holds most rows lies in many of them; what a tree has in
    earlier ranges is summed from one row per tree and range. Rows that are equal in all these columns share a range: a
    caller with many of them adds a column that tells them apart.
    """
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    # the id holds the range in its upper bits and the place in it in the lower ones
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), folder).withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "_part", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_base"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") - F.col("_base")).drop("_at", "_part", "_base")
