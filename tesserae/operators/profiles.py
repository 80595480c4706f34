"""User profiles: what they may choose from, and what is looked up for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interest_options(categories: list[str], *more: str) -> F.Column:
    """The categories and further options, each once, in this order."""
    return F.array_distinct(F.concat(F.array(*map(F.lit, categories)), F.array(*map(F.lit, more)).cast("array<string>")))


def looked_up(profiles: DataFrame, colleges: DataFrame, homepages: DataFrame, default: str = "other") -> DataFrame:
    """Profiles (college, track, ...) with the tracks of their college, the default where it is unknown, and the homepage of their track, null where it has none.

    colleges: (college, track); homepages: (track, url), one for each track. Both are small and joined as Spark sees fit.
    """
    tracks = colleges.groupBy("college").agg(F.array_sort(F.collect_set("track")).alias("tracks"))
    pages = homepages.groupBy("track").agg(F.max("url").alias("homepage"))
    return profiles.join(tracks, "college", "left").join(pages, "track", "left").withColumn("tracks", F.coalesce("tracks", F.array(F.lit(default))))
