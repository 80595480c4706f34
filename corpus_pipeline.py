"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one reads it. SQL cannot express
the classifiers and the tokeniser, so there is no SQL for the whole. Tests compare each stage with a plain version: the two
classifiers row by row with the operators' own functions, near duplicates and repeated passages with all pairs and all
strings, packed ids with the tokenizers library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import stages
from tesserae.llm.common import shared_dir

STAGES = [
    ("language", stages.language),
    ("quality", stages.good_quality),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("packing", stages.packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; a row per piece of a packed sequence."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
