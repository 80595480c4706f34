"""Tables that grow by versions: each change is a folder of its own, written once, and counts when it is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Tables below one path, each with a folder ``version=v`` for a change.

    A change is written table by table and is committed last; one that was stopped before is not seen and is written
    anew under the same number, so running it again changes nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _marked(self, marks: str) -> list[int]:
        fs, where = self._fs(f"{self.path}/{marks}/version=*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(where) or [])

    def committed(self) -> list[int]:
        """The versions that count: those from the last one on that stands for all before it."""
        known, bases = self._marked("commits"), set(self._marked("bases"))
        base = max((v for v in known if v in bases), default=-1)
        return [v for v in known if v >= base]

    def next(self) -> int:
        return max(self._marked("commits"), default=-1) + 1

    def write(self, version: int, table: str, rows: DataFrame, *partitions: str, sort: tuple[str, ...] = (), dealt: bool = False) -> None:
        """Writes the table's part of a version, in place of what a stopped run may have left. Partitions are brought together in one task each unless they are large; dealt: they are already."""
        if partitions and not dealt:
            rows = rows.hint("rebalance", *map(F.col, partitions))
        if sort:
            rows = rows.sortWithinPartitions(*partitions, *sort)
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(f"{self.path}/{table}/version={version}")

    def commit(self, version: int, base: bool = False) -> None:
        """base: from now on the version stands for all before it, too."""
        for marks in ("bases", "commits") if base else ("commits",):
            fs, where = self._fs(f"{self.path}/{marks}/version={version}/_SUCCESS")
            fs.create(where, True).close()

    def read(self, table: str) -> DataFrame:
        """All committed versions of a table, with the column ``version``; filters on partitions reach the files."""
        known = self.committed()
        schema = f"{self.schemas[table]}, version int"
        folders = [f"{self.path}/{table}/version={v}" for v in known]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*folders)

    def clean(self) -> None:
        """Removes versions that no longer count."""
        known = self.committed()
        for v in self._marked("commits"):
            if known and v < known[0]:
                for table in ("commits", "bases", *self.schemas):
                    fs, where = self._fs(f"{self.path}/{table}/version={v}")
                    fs.delete(where, True)
