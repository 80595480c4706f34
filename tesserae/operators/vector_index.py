"""A stored vector index: cells around centres, a Parquet partition each, of which a query reads those nearest to it.

Centres are those of k-means on a sample of at most SAMPLE unit vectors; every row is filed in the cell of its nearest centre. A search
finds the cells of each query, reads only the partitions that some query probes, and meets rows and queries cell by cell; rows of a
large cell are dealt out, so no cell has to fit one task. Probing all cells is the exact search. An upsert rewrites the cells that its rows
leave or enter, and no other.

Similarity is the cosine; that with zeros is 0. Rows without an id or a vector, or with a null, NaN or infinite component, and those of
another length than the sample's take no part. Of several rows of one id one counts. Ties, to 12 decimals, go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators.order import checkpointed
from tesserae.operators.search import _matrix, _vectors
from tesserae.sources.files import replace_partitions

#: Rows that the centres are fitted on, and rows of a cell that one task meets.
SAMPLE, ROWS = 50_000, 16_384
SCHEMA = "id long, v array<double>, cell int"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres_of(x: np.ndarray, cells: int, rounds: int = 25, seed: int = 0) -> np.ndarray:
    """Unit centres of spherical k-means; a cell that loses all its rows begins anew at the row that its own centre suits least."""
    x, rng = _unit(np.asarray(x, dtype=np.float64)), np.random.default_rng(seed)
    cells = min(cells, len(np.unique(x, axis=0))) if len(x) else 0
    if not cells:
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        of, sums = near.argmax(1), np.zeros_like(centres)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=cells) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        new = _unit(sums)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


class VectorIndex:
    """The index below a path. cells: 0 for about the square root of the number of rows, 4096 at most."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector_col = spark, path.rstrip("/"), id_col, vector_col

    def build(self, rows: DataFrame, cells: int = 0, sample: int = SAMPLE, seed: int = 0) -> None:
        """Fits centres on a bounded sample, files every row, and replaces what was there."""
        rows = _vectors(rows, self.id_col, self.vector_col)
        n = rows.count()
        some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * sample / n))
        some = some.limit(sample).toPandas()
        dim = int(some["v"].map(len).mode().min()) if len(some) else 0
        x = np.stack(some["v"][some["v"].map(len) == dim]) if dim else np.zeros((0, 0))
        centres = centres_of(x, cells or min(4096, max(1, int(n**0.5))), seed=seed)
        table = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        self._filed(rows).hint("rebalance", F.col("cell")).write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{self.path}/cells")

    def centres(self) -> np.ndarray:
        """One row a cell: 4096 at most."""
        found = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in found])

    def rows(self) -> DataFrame:
        """(id, v, cell); a filter on cells reaches the files."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/cells")

    def _filed(self, rows: DataFrame) -> DataFrame:
        """(id, v, cell): each row in the cell of its nearest centre; one row for each id."""
        centres = self.centres()
        schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32())])

        def file(batches):
            for batch in batches:
                if batch.num_rows:
                    cell = (_matrix(batch.column("v")) @ centres.T).argmax(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("v").cast(pa.list_(pa.float64())), pa.array(cell)], schema=schema)

        rows = rows.groupBy("id").agg(F.max("v").alias("v")).filter(F.size("v") == (centres.shape[1] if centres.size else -1))
        return rows.mapInArrow(file, SCHEMA)

    def upsert(self, rows: DataFrame) -> list[int]:
        """Puts rows in; those with a known id replace it. Returns the cells that were rewritten."""
        new = checkpointed(self._filed(_vectors(rows, self.id_col, self.vector_col)))
        old = self.rows().select("id", "cell").join(new.select("id"), "id", "left_semi").select("cell")
        touched = sorted(r[0] for r in old.union(new.select("cell")).distinct().collect())  # cells, 4096 at most
        held = self.rows().filter(F.col("cell").isin(touched)).join(new.select("id"), "id", "left_anti").select("id", "v", "cell")
        replace_partitions(held.unionByName(new), f"{self.path}/cells", "cell", touched)
        return touched

    def _probes(self, queries: DataFrame, probes: int) -> DataFrame:
        """(id, v, cell): each query with each of its nearest cells."""
        centres = self.centres()
        schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32())])
        m = min(probes, len(centres))

        def probe(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    near = np.argsort(-(_matrix(part.column("v")) @ centres.T), axis=1, kind="stable")[:, :m]
                    at = pa.array(np.repeat(np.arange(part.num_rows), m))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at).cast(pa.int64()), part.column("v").take(at).cast(pa.list_(pa.float64())), pa.array(near.ravel().astype(np.int32))], schema=schema)

        dim = centres.shape[1] if centres.size else -1
        return queries.filter(F.size("v") == dim).mapInArrow(probe, SCHEMA)

    def search(self, queries: DataFrame, k: int, probes: int = 8, id_col: str = "query_id", vector_col: str = "embedding", same: bool = True, read: list | None = None) -> DataFrame:
        """(query_id, rank, id, similarity): the k most similar rows found in the nearest cells of each query.

        probes: cells of a query; with as many as there are the result is exact. same: whether a row may be found for the query of its own id.
        read: gets (pairs of a query and a row that met, pairs of all queries and rows, rows read, rows).
        """
        wanted = checkpointed(self._probes(_vectors(queries, id_col, vector_col), probes))
        cells = [r[0] for r in wanted.select("cell").distinct().collect()]  # 4096 at most
        held = self.rows().filter(F.col("cell").isin(cells))
        sizes = held.groupBy("cell").agg(F.count("*").alias("n"))
        parts = sizes.select("cell", "n", F.ceil(F.col("n") / ROWS).cast("int").alias("parts"))
        if read is not None:
            asked = wanted.groupBy("cell").agg(F.count("*").alias("q")).join(sizes, "cell").agg(F.sum(F.col("q") * F.col("n")), F.sum("n")).first()
            n = self.rows().count()
            read.append((asked[0] or 0, wanted.select("id").distinct().count() * n, asked[1] or 0, n))
        left = wanted.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = held.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
        most = k if same else k + 1  # a query's own row is left out below

        def meet(q, r):
            if not (q.num_rows and r.num_rows):
                return schema.empty_table()
            r = r.sort_by("id")
            ids, at, x, units, out = q.column("id").to_numpy(), r.column("id").to_numpy(), _unit(_matrix(r.column("v"))).T, _unit(_matrix(q.column("v"))), ([], [], [])
            for a in range(0, len(ids), 256):
                for i, row in zip(ids[a : a + 256], np.round(units[a : a + 256] @ x, 12), strict=True):
                    found = np.flatnonzero(row >= np.partition(row, len(row) - most)[len(row) - most]) if len(row) > most else np.arange(len(row))
                    found = found[np.argsort(-row[found], kind="stable")][:most]
                    out[0].append(np.full(len(found), i)), out[1].append(at[found]), out[2].append(row[found])
            return pa.table([pa.array(np.concatenate(c)) for c in out], schema=schema)

        names = ["id", "v", "cell", "part"]
        met = left.select(*names).groupBy("cell", "part").cogroup(right.select(*names).groupBy("cell", "part")).applyInArrow(meet, "query_id long, id long, similarity double")
        if not same:
            met = met.filter("query_id <> id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
