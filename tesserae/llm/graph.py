"""Connected components of a table of links, by alternating large and small stars.

Each round moves every node's larger neighbours to the smallest one it knows (large star) and then its smaller ones
(small star), until only stars around the smallest node of each component are left. Minima are
combined before they are shuffled and written before they are joined, so that adaptive execution can split the join on a
hub. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import shared_dir, written


def _large_star(links: DataFrame, folder: str) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), folder)
    return written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), folder)


def _small_star(links: DataFrame, folder: str) -> DataFrame:
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), folder)
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_done(links: DataFrame) -> bool:
    """Whether the links (larger node, smaller node) are stars: no larger node has two smaller ones, or is one itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long, not null) to (node, component), component being the smallest node reachable; nodes without a link are not in it."""
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    folder = shared_dir(links.sparkSession)
    links = written(links, folder)
    while not _is_done(links):
        links = written(_small_star(_large_star(links, folder), folder), folder)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
