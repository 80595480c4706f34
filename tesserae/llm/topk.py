"""Operator 4: exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into buckets, cut into blocks of bounded size. A query knows a score that k candidates
reach at least, first from a fixed number of the longest vectors; a bucket whose longest vector cannot bring the query
that far (a local cosine threshold above 1) never meets it. In a block the rows go in descending length, part by part, and
what has been verified raises the score to reach. For each part the local threshold chooses: where only length can
exclude a row, rows too short are cut (length pruning); else rows are cut by coordinates, too: the product over the
query's largest coordinates and the lengths of what remains of both vectors bound the whole product, for more and more
coordinates and fewer and fewer rows (coordinate pruning). What is left is verified by its product in whole numbers.

Vectors are quantised to floor(scale * x) in double. Vectors that are null, empty, or hold null or non-finite
components (or ones of 1e150 and more) take no part; rows of another number of components are not compared; rows that share the query's id count as
its own. Zero vectors take part. Ties go to the smaller id; with fewer candidates than k all are returned; a query without
candidates has no row. Rows that repeat an id are candidates each, and as queries give one list together. Products beyond 64 bits are cut to the largest or smallest. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import record_batch
from tesserae.llm.vectors import best, blocks, meet, merged, valid

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Norm buckets, longest vectors that give the first bounds, and rows of the parts of a block between which bounds rise.
BUCKETS, SEEDS, PART = 8, 256, 2048
#: Shares of a query's coordinates, largest first, after which rows are cut, and the local threshold under which only lengths are looked at.
FOCUS, LENGTH_UNTIL = (0.25, 0.5, 0.75), 0.02


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers: float64 where every product is exact in it, Python's integers beyond."""
    q = np.floor(scale * vectors)
    return q if not q.size or np.abs(q).max() ** 2 * q.shape[1] < 2**53 else np.array([[int(x) for x in row] for row in q], dtype=object)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as int64."""
    if a.dtype == object or b.dtype == object or (a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53):
        whole = lambda m: m if m.dtype == object else np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
        return np.clip(np.dot(whole(a), whole(b).T), -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def lengths(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q.astype(float) ** 2).sum(1))


def prune(query: np.ndarray, length: float, floor: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places of the rows, in descending length, that can reach the score ``floor``; norms: the lengths of the rows, descending."""
    if not len(rows):
        return np.arange(0)
    slack = 1e-9 * length * norms[0] + 1e-9  # for the rounding of lengths and partial products
    kept = np.arange(int(np.searchsorted(-norms, -(floor - slack) / length, side="right")) if floor > slack and length else 0 if floor > slack else len(rows))
    if not len(kept) or not length or floor < LENGTH_UNTIL * length * norms[0]:
        return kept
    by_size = np.argsort(-np.abs(query), kind="stable")
    rest_q, rest_x, partial, done = length**2, norms[kept] ** 2, np.zeros(len(kept)), 0
    for share in FOCUS:
        some = by_size[done : max(done + 1, int(share * len(query)))]
        done += len(some)
        part = rows.T[some] if len(kept) == len(rows) else rows.T[some[:, None], kept]
        partial, rest_x = partial + query[some] @ part, rest_x - np.einsum("ij,ij->j", part, part)
        rest_q -= float((query[some] ** 2).sum())
        stays = partial + np.sqrt(max(0.0, rest_q) * np.maximum(0, rest_x)) + slack >= floor
        kept, partial, rest_x = kept[stays], partial[stays], rest_x[stays]
        if not len(kept) or done >= len(query):
            break
    return kept


class Block:
    """A block's rows, quantised, in descending length, ties by id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, scale: float):
        rows = quantised(v, scale)
        norms = lengths(rows)
        order = np.lexsort((ids, -norms))
        self.ids, self.rows, self.norms = ids[order], rows[order], norms[order]
        self.plain = np.asfortranarray(self.rows.astype(float))  # by coordinate, as prune() reads it


def search_block(block: Block, q_id: int, q: np.ndarray, floor: float, k: int, verified: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of the block for a quantised query; rows that cannot reach ``floor`` may be left out. ``verified`` takes the number of whole products."""
    plain, length = q.astype(float), float(lengths(q[None])[0])
    ids, scores, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for a in range(0, len(block.ids), PART):
        if len(scores) >= k:
            floor = max(floor, float(scores.min()))
        if floor > 0 and length * block.norms[a] * (1 + 1e-9) < floor:
            break
        at = a + prune(plain, length, floor, block.plain[a : a + PART], block.norms[a : a + PART])
        at = at[block.ids[at] != q_id]
        if len(at):
            n += len(at)
            ids, scores = np.concatenate([ids, block.ids[at]]), np.concatenate([scores, products(q[None], block.rows[at])[0]])
            top = best(scores, ids, k)
            ids, scores = ids[top], scores[top]
    if verified is not None:
        verified.append(n)
    return ids, scores


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k highest products of every row for which ``is_query`` (a column of ``id``) holds."""
    rows = valid(vectors, id_col, vector_col, zero=True)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double")))
    rows = rows.withColumn("norm", norm)
    stats = rows.agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("dim"), F.max("norm").alias("longest"),
        F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 2000).alias("cuts"),
    ).first()
    uppers = [*sorted(set(stats["cuts"] or [])), float("inf")]  # the greatest length of each bucket
    uppers = [min(u, stats["longest"] or 0.0) for u in uppers]
    per_bucket = max(1, -(-blocks(stats["n"], stats["dim"] or 1) // len(uppers)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in uppers[:-1]]).cast("array<double>"), lambda c: c < F.col("norm")))
    placed = rows.withColumn("block", (bucket * per_bucket + F.pmod(F.xxhash64("id"), F.lit(per_bucket))).cast("int"))
    seeds = rows.orderBy(F.desc("norm"), "id").limit(SEEDS).select("id", "v").toArrow()
    by_dim: dict[int, tuple[list, list]] = {}
    for i, v in zip(seeds.column("id").to_pylist(), seeds.column("v").to_pylist(), strict=True):
        for held, value in zip(by_dim.setdefault(len(v), ([], [])), (i, v), strict=True):
            held.append(value)
    seed_rows = {d: (np.array(i), quantised(np.array(v), scale)) for d, (i, v) in by_dim.items()}

    def bound(batches):
        """Adds the score that k of the seeds reach, or -inf, and the blocks that hold rows long enough for it."""
        for batch in batches:
            floors, to = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = quantised(np.array([v]), scale)
                seed_ids, x = seed_rows.get(len(v), (np.zeros(0), np.zeros((0, len(v)))))
                score = products(q, x)[0][seed_ids != i] if len(seed_ids) else []
                floor = float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -np.inf
                reach = float(lengths(q)[0]) * (1 + 1e-9)
                floors.append(floor)
                to.append([b * per_bucket + c for b, upper in enumerate(uppers) if floor <= 0 or reach * upper >= floor for c in range(per_bucket)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors, pa.float64()), pa.array(to, pa.list_(pa.int32()))], names=["id", "v", "bound", "to"])

    queries = rows.filter(is_query).select("id", "v").mapInArrow(bound, "id long, v array<double>, bound double, to array<int>")

    def search(block, q_ids, q, floors):
        out: list[list] = [[], [], []]
        for i, row, floor in zip(q_ids, quantised(q, scale), floors, strict=True):
            ids, scores = search_block(block, i, row, floor, k)
            for held, value in zip(out, (np.full(len(ids), i), ids, scores), strict=True):
                held.append(value)
        yield record_batch(FOUND, *(pa.array(np.concatenate(c).astype(np.int64)) for c in out))

    found = meet(placed.select("id", "v", "block"), queries, per_bucket * len(uppers), stats["q"], lambda ids, v: Block(ids, v, scale), search, "query_id long, vec_id long, score long")
    return merged(found, k)
