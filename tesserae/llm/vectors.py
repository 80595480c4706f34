"""What the two vector searches share: valid rows, blocks that stay while queries stream past them, and the last merge.

A query set is searched against all rows in blocks. Every row is shuffled to its block once, by a hash of its id, so a
vector that repeats does not gather in one block; a query is sent to each block that can hold an answer. A task sorts a
block before the queries, builds what it needs of the block once, and takes the queries batch by batch, so its memory
is bounded by the block and not by the query set. Only where there are fewer blocks than cores is a block held by several
tasks, which share its queries. Each meeting gives at most k rows for each query, which a window then merges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes of a block at most (in the mean: rows are dealt by a hash), and queries that one task should have at least.
BLOCK_ROWS, BLOCK_BYTES, TASK_QUERIES = 32_768, 64 << 20, 16
LARGEST = 1e150


def valid(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id and vector (array<double>) of the rows that take part: no null, NaN or infinite component, and none of LARGEST or more, whose square would be infinite; with ``zero`` all-zero vectors too."""
    v = F.col("v")
    kept = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & kept)
    return rows if zero else rows.filter(F.exists(v, lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def blocks(n: int, dim: int) -> int:
    """Blocks for n rows of at most so many components."""
    return max(1, math.ceil(n / max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))))


def width(df: DataFrame, n_blocks: int, n_queries: int) -> int:
    """Tasks for each block: more than one only as long as there are fewer blocks than twice the cores."""
    return max(1, min(math.ceil(2 * df.sparkSession.sparkContext.defaultParallelism / n_blocks), math.ceil(n_queries / TASK_QUERIES)))


def meet(rows: DataFrame, queries: DataFrame, n_blocks: int, n_queries: int, build, search, schema: str) -> DataFrame:
    """Streams the queries past the blocks of rows of as many components.

    rows: (id, v, block); queries: (id, v, bound double, to: array of blocks). build(ids, matrix) makes a block, of ids
    in ascending order; search(block, ids, matrix, bounds) yields record batches.
    """
    w = width(rows, n_blocks, n_queries)
    part = (F.col("block") * w).cast("int")
    left = rows.select(F.explode(F.sequence(part, part + (w - 1))).alias("part"), F.size("v").alias("dim"), F.lit(0).alias("side"), "id", "v", F.lit(None).cast("double").alias("bound"))
    right = queries.select("id", "v", "bound", F.explode("to").alias("block")).select((part + F.pmod(F.xxhash64("id"), F.lit(w))).cast("int").alias("part"), F.size("v").alias("dim"), F.lit(1).alias("side"), "id", "v", "bound")

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            side, of = batch.column(2).to_numpy(), np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cuts = np.flatnonzero((of[1:] != of[:-1]).any(1) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(side)], strict=True):
                a, b = int(a), int(b)
                if tuple(of[a]) != key:
                    key, held, block = tuple(of[a]), [], None
                ids, v = batch.column(3).slice(a, b - a).to_numpy(), matrix(batch.column(4).slice(a, b - a))
                if not side[a]:
                    held.append((ids, v))
                elif held or block is not None:  # else no row has as many components
                    if block is None:
                        block = build(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
                        held = []
                    yield from search(block, ids, v, batch.column(5).slice(a, b - a).to_numpy(zero_copy_only=False))

    dealt = left.unionByName(right).repartitionById(n_blocks * w, F.col("part")).sortWithinPartitions("part", "dim", "side", "id")
    return dealt.mapInArrow(run, schema)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    found = np.arange(len(score))
    if len(found) > k:
        found = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return found[np.lexsort((ids[found], -score[found]))][:k]


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
