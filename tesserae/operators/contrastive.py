"""A linear contrastive encoder that is trained where its rows are.

A text is the bag of its tokens, hashed to ``features`` places; the encoder is a matrix that maps it to a vector of ``size``,
scaled to length 1. Of the pairs of a batch each query has to find its own positive among all of them. Training runs as one barrier
stage: a task holds the tokens of its batches, and in each round all tasks exchange the sums of their gradients, as large as
the matrix and however many rows there are, and take the same step. No row comes to the driver. Which task has which batches does not matter
beyond the rounding of sums; a task that is lost lets the stage begin anew, and the same model comes out.

Pairs with a null query or positive are left out. A text without tokens has the vector of zeros.
"""

from __future__ import annotations

import base64
from dataclasses import asdict, dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T


@dataclass(frozen=True)
class Shape:
    features: int = 2048
    size: int = 32
    temperature: float = 0.1
    rounds: int = 30
    rate: float = 2.0
    momentum: float = 0.8
    seed: int = 42


def hashed_tokens(text: Column | str, features: int) -> Column:
    """Places of a text's tokens, repeats included."""
    return F.transform(T.tokenize(text), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def _bags(tokens: list | pa.Array, features: int) -> np.ndarray:
    tokens = tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(tokens)), np.asarray(pc.list_value_length(tokens)))
    return np.log1p(np.bincount(row * features + np.asarray(tokens.flatten()), minlength=len(tokens) * features).astype(float).reshape(-1, features))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / norm, norm


def gradient(weights: np.ndarray, queries: list | pa.Array, positives: list | pa.Array, shape: Shape) -> tuple[float, np.ndarray]:
    """(loss, gradient) of one batch: the cross entropy of each query's own positive among those of the batch."""
    xq, xp = _bags(queries, shape.features), _bags(positives, shape.features)
    (uq, nq), (up, np_) = _unit(xq @ weights), _unit(xp @ weights)
    s = uq @ up.T / shape.temperature
    s -= s.max(1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(1, keepdims=True)
    n = len(p)
    loss = float(-np.log(np.maximum(p[np.arange(n), np.arange(n)], 1e-300)).mean())
    p[np.arange(n), np.arange(n)] -= 1
    p /= n * shape.temperature
    dq, dp = p @ up, p.T @ uq
    dq = (dq - uq * (uq * dq).sum(1, keepdims=True)) / nq
    dp = (dp - up * (up * dp).sum(1, keepdims=True)) / np_
    return loss, xq.T @ dq + xp.T @ dp


def start(shape: Shape) -> np.ndarray:
    return np.random.default_rng(shape.seed).normal(size=(shape.features, shape.size)) / shape.size**0.5


def train(pairs: DataFrame, path: str, shape: Shape = Shape(), tasks: int = 0) -> DataFrame:
    """Trains on pairs (query, positive, batch) and writes the encoder to the path; returns (round, loss), the mean over the batches before each round and after the last.

    tasks: of the barrier stage, all of which have to run at once; as many as the session has cores by default.
    """
    spark = pairs.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    rows = pairs.filter("query is not null and positive is not null")
    rows = rows.select(F.col("batch").cast("long").alias("batch"), hashed_tokens("query", shape.features).alias("q"), hashed_tokens("positive", shape.features).alias("p"))
    rows = rows.repartition(tasks, "batch").sortWithinPartitions("batch", "q", "p")
    schema = pa.schema([("round", pa.int32()), ("loss", pa.float64()), ("weights", pa.binary())])

    def run(batches):
        held: dict[int, pa.Table] = {}  # as Arrow, four bytes a token
        for batch in batches:
            of = batch.column("batch").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in pairwise(cuts) if len(of) else []:
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                held[int(of[a])] = pa.concat_tables([held[int(of[a])], part]) if int(of[a]) in held else part
        context = BarrierTaskContext.get()
        weights, speed, losses = start(shape), 0.0, []
        for step in range(shape.rounds + 1):
            loss, total = 0.0, np.zeros_like(weights)
            for rows in held.values():
                one, slope = gradient(weights, *(rows.column(c).combine_chunks() for c in ("q", "p")), shape)
                loss, total = loss + one, total + slope
            message = np.concatenate([[len(held), loss], total.ravel()]).astype("<f8").tobytes()
            every = [np.frombuffer(base64.b64decode(m), "<f8") for m in context.allGather(base64.b64encode(message).decode())]
            n, loss, slope = sum(m[0] for m in every), sum(m[1] for m in every), sum(m[2:] for m in every)
            if not n:
                break
            losses.append(loss / n)
            if step < shape.rounds:
                speed = shape.momentum * speed - shape.rate * slope.reshape(weights.shape) / n
                weights = weights + speed
        if context.partitionId() == 0:
            last = [weights.astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(losses)), -1], pa.int32()), pa.array([*losses, None], pa.float64()), pa.array([None] * len(losses) + last, pa.binary())], schema=schema)

    rows.mapInArrow(run, "round int, loss double, weights binary", barrier=True).withColumns({k: F.lit(v) for k, v in asdict(shape).items() if k in ("features", "size")}).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).filter("round >= 0").select("round", "loss")


def load(spark: SparkSession, path: str) -> np.ndarray:
    """The matrix of an encoder: one row of a file."""
    row = spark.read.parquet(path).filter("round = -1").first()
    return np.frombuffer(row["weights"], "<f8").reshape(row["features"], row["size"])


def encode(text: Column | str, weights: np.ndarray) -> Column:
    """The vectors of texts, array<float>."""
    features = len(weights)

    def run(tokens: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(tokens), 256):
            x = _bags(list(tokens[a : a + 256]), features) @ weights
            out += list(_unit(x)[0].astype(np.float32))
        return pd.Series(out)

    return F.pandas_udf(run, "array<float>")(hashed_tokens(text, features))


class ContrastiveTrainer:
    """For training.finetune_all(): trains on the rows where they are."""

    def __init__(self, shape: Shape = Shape(), tasks: int = 0):
        self.shape, self.tasks = shape, tasks

    def train_rows(self, rows: DataFrame, path: str) -> None:
        train(rows, path, self.shape, self.tasks)
