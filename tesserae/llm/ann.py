"""Operator 8: approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected on a few Gaussian directions, so that a squared projected distance divided by the squared distance
follows a chi-square law. In each block of rows a kd-tree holds the projections. A query takes the rows of a block in
the order of their projected distance, radius by radius, and verifies them by products on the whole vectors. It stops
when a row as near as its k-th best so far would, with the wanted probability, have been projected within the radius
that has been searched. Every row is indexed, and there is nothing to fit.

Nearness is the largest inner product. With a coordinate that brings all rows of a block to one length, and queries
scaled to it, it is the smallest distance. Products are summed in one fixed order, so equal vectors have equal scores.

Vectors that are null, empty, all zero, or hold null or non-finite components (or ones of 1e150 and more) take no part; rows of another number of
components are not compared; rows that share the query's id count as its own. Ties go to the smaller id; with fewer
candidates than k all are returned, for the test does not stop a query that has found fewer. Rows that repeat an id
are candidates each, and as queries give one list together. Other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import record_batch
from tesserae.llm.vectors import best, blocks, meet, merged, valid

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: Directions, rows of a leaf, the probability that a near row has been seen when a search stops, and how fast squared radii grow.
DIRECTIONS, LEAF, CONFIDENCE, GROWTH = 24, 128, 0.93, 1.2


def chi_square_cdf(x: float, m: int) -> float:
    """P(chi-square of m degrees <= x), by the series of the incomplete gamma function."""
    a, x = m / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int = DIRECTIONS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, m))


class KdTree:
    """Leaves of about equally many points, cut at the median of the widest coordinate, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves, stack = [], [np.arange(len(points))]
        while stack:
            at = stack.pop()
            if len(at) <= leaf:
                self.leaves.append(at)
                continue
            part = points[at]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            order = np.argpartition(part[:, axis], len(at) // 2)
            stack += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        self.low = np.array([points[x].min(0) for x in self.leaves])
        self.high = np.array([points[x].max(0) for x in self.leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(q), len(self.leaves)))
        for j in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[None, :, j] - q[:, j, None], q[:, j, None] - self.high[None, :, j]), 0)
            out += gap * gap
        return out


class Block:
    """A block's rows in the order of the leaves of their kd-tree, with their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        norms = (x * x).sum(1)
        self.longest = float(norms.max())
        extra = np.sqrt(np.maximum(0, self.longest - norms))  # brings all rows to one length
        self.by = directions(x.shape[1] + 1)
        points = np.hstack([x, extra[:, None]]) @ self.by
        self.tree = KdTree(points)
        order = np.concatenate(self.tree.leaves)
        self.cuts = np.cumsum([0, *map(len, self.tree.leaves)])
        self.ids, self.x, self.points = ids[order], x[order], points[order]
        self.squares, self.norms = (self.points * self.points).sum(1), np.sqrt(norms[order])


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in one fixed order, so that equal vectors have equal ones wherever they stand."""
    return (rows * q).sum(1)


def search_block(block: Block, q_ids: np.ndarray, q: np.ndarray, k: int, quantile: float, verified: list | None = None):
    """The k best found in the block for each query: (query's place, ids, scores). ``verified`` takes the number of products of each.

    Rounds of growing radius: a round opens the leaves whose boxes the radius reaches and verifies the rows projected
    within it. A query is done when its radius has reached ``quantile`` times its k-th squared distance so far.
    """
    # a query is brought to the rows' length, which changes no order of its products
    lengths = np.sqrt((q * q).sum(1))
    proj = (q * (math.sqrt(block.longest) / lengths)[:, None]) @ block.by[:-1]
    near, squares = block.tree.distances(proj), (proj * proj).sum(1)
    base, per_product = 2 * block.longest, 2 * math.sqrt(block.longest) / lengths  # squared distance = base - per_product * product
    own = block.ids[None, :] == q_ids[:, None]
    far = np.full(own.shape, np.inf)  # squared projected distances, where a leaf has been opened

    def open_leaves(which):
        for leaf in np.flatnonzero(which.any(0)):
            who, (a, b) = np.flatnonzero(which[:, leaf]), block.cuts[leaf : leaf + 2]
            far[who, a:b] = np.maximum(0, squares[who, None] + block.squares[None, a:b] - 2 * (proj[who] @ block.points[a:b].T))
        far[own] = np.inf
        near[which] = np.inf  # of closed leaves only

    first = near == near.min(1, keepdims=True)
    open_leaves(first)
    # the first radius reaches k rows of the nearest leaf, or all it has
    outer = np.where(np.isfinite(far), far, -1.0).max(1)
    outer = np.minimum(outer, np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1])
    found = [([], []) for _ in q]
    top, active = [np.zeros(0)] * len(q), np.arange(len(q))
    inner = np.full(len(q), -1.0)
    while len(active):
        reach = np.zeros(near.shape, dtype=bool)
        reach[active] = near[active] <= outer[active, None]
        open_leaves(reach & np.isfinite(near))
        still = []
        for j in active:
            at = np.flatnonzero((far[j] > inner[j]) & (far[j] <= outer[j]) & np.isfinite(far[j]))
            if len(at):
                s = block.x[at] @ q[j]
                found[j][0].append(at), found[j][1].append(s)
                top[j] = np.concatenate([top[j], s])
                top[j] = np.partition(top[j], max(0, len(top[j]) - k))[max(0, len(top[j]) - k) :]
            limit = quantile * max(0.0, base - per_product[j] * top[j].min()) + 1e-9 * base if len(top[j]) == k else np.inf
            unseen = min(near[j].min(), np.where(far[j] > outer[j], far[j], np.inf).min())
            inner[j] = outer[j]
            if unseen <= limit and np.isfinite(unseen):
                outer[j] = min(max(GROWTH * outer[j], unseen), limit)
                still.append(j)
        active = np.array(still, dtype=np.int64)
    for j, (at, s) in enumerate(found):
        at, s = np.concatenate([np.zeros(0, dtype=np.int64), *at]), np.concatenate([np.zeros(0), *s])
        if verified is not None:
            verified.append(len(at))
        if len(at) > k:  # with all that rounding could bring among the k best
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-12 * lengths[j] * math.sqrt(block.longest)]
        s = products(block.x[at], q[j])
        chosen = best(s, block.ids[at], k)
        yield j, block.ids[at[chosen]], s[chosen]


def nearest(vectors: DataFrame, is_query, k: int = 20, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row for which ``is_query`` (a column of ``id``) holds."""
    rows = valid(vectors, id_col, vector_col, zero=False)
    stats = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("dim")).first()
    n_blocks, quantile = blocks(stats["n"], stats["dim"] or 1), chi_square_quantile(confidence, DIRECTIONS)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int"))
    queries = rows.filter(is_query).select("id", "v", F.lit(None).cast("double").alias("bound"), F.sequence(F.lit(0), F.lit(n_blocks - 1)).alias("to"))

    def search(block, q_ids, q, _):
        step = max(8, (32 << 20) // (8 * len(block.x)))
        for at in range(0, len(q), step):
            found = [(np.full(len(ids), q_ids[at + j]), ids, score) for j, ids, score in search_block(block, q_ids[at : at + step], q[at : at + step], k, quantile)]
            yield record_batch(FOUND, *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True)))

    return merged(meet(placed, queries, n_blocks, stats["q"], Block, search, "query_id long, vec_id long, score double"), k)
