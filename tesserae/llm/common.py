"""What the training-data operators share: tables, the shared folder, and small Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.order import removed_at_exit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The path of a new folder below the one that all executors share; what is in it is removed when the application ends.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs on one machine, as in
    tests, a temporary folder is taken and set as the checkpoint folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not base and jsc.getCheckpointDir().isDefined():
        base = jsc.getCheckpointDir().get()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return removed_at_exit(spark, f"{base.rstrip('/')}/tesserae-{uuid.uuid4().hex}") + "/data"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back; compressed, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, None for another store."""
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else None


def filesystem(uri: str) -> tuple[object, str]:
    """A pyarrow filesystem and a path in it, for any store that pyarrow knows."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(uri)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches, limit_bytes: int = 8 << 20, column: int = 1):
    """Cuts Arrow batches into row ranges of about ``limit_bytes`` of text, so that memory stays bounded."""
    for batch in batches:
        start, n = 0, batch.num_rows
        size = max(1, batch.column(column).nbytes // max(1, n))
        step = max(1, limit_bytes // size)
        while start < n:
            part = batch.slice(start, step)
            yield part
            start += step


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def ensure_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)


def exists(path: str) -> bool:
    return os.path.exists(path)


_RELEASES: dict = {}
_ACTIVE = ""


def released_by_others(clear):
    """Registers what empties an operator's cache in a Python worker; see active()."""
    _RELEASES[f"{clear.__module__}.{id(clear)}"] = clear
    return clear


def active(owner: str) -> None:
    """Called where an operator, or a part of one, starts in a Python worker. Workers live on from stage to stage: when
    another one takes over, the caches of the one before are emptied and all free memory goes back to the system."""
    global _ACTIVE
    if _ACTIVE == owner:
        return
    if _ACTIVE:
        for clear in _RELEASES.values():
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not everywhere
            ctypes.CDLL(None).malloc_trim(0)
    _ACTIVE = owner
