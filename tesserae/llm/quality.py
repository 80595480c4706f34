"""Operator 1: a quality classifier on random-indexing word vectors.

Every word of the vocabulary has a sparse random index vector, made from a hash of the word; its word vector is the
sum of the index vectors of its neighbours in the sample, normalised, plus its own. Words stand beside tokens for their
shape (capitals, digits, lengths), runs of marks, and a document's own measures (length, share of repeated words), which
are words like others, so that texts of unknown words have vectors too. A document is the mean of its vectors, from its
whole text. A network of two layers, in numpy, gives a logit, and a temperature fitted on rows it has not been trained
on makes it a probability.

The model is fitted on a bounded sample of the labelled rows: at most about ``rows_per_class`` of each label, chosen by a
hash of the id, and all of their texts. The executors count the words, sum their neighbours and pool the documents; the
driver gets the vocabulary (words that the sample has ``MIN_COUNT`` times), its vectors and a vector of each row, and trains
the network. Scoring reads whole texts, handles every row by itself and shuffles nothing.

Null text counts as empty, which has a score as well: that of its measures alone. Rows of a null label or text are not
learned from; with one label only, or none, every score is the share of label 1 (0.5 if there is none); two rows of
different labels are enough for a network. Empty tables
give empty results; repeated rows are scored each; other columns are not carried.
"""

from __future__ import annotations

import operator
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tesserae.llm.common import active, record_batch, slices, written
from tesserae.llm.tokens import Cache

OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
DIM, NONZERO, WINDOW, HIDDEN, MIN_COUNT = 96, 6, 2, 48, 4
#: Tasks that fit.
FIT_PARTS = 12
_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")


def index_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each word's few entries that are not zero: random, but always the same for a word."""
    h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64)[:, None] + (np.arange(1, NONZERO + 1, dtype=np.uint64) << np.uint64(33))[None, :]
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    h ^= h >> np.uint64(31)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0) / np.sqrt(NONZERO)


def _sums(rows: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Adds sparse entries to the rows of an n x DIM table."""
    return np.bincount((rows[:, None] * DIM + places).ravel(), values.ravel(), n * DIM).reshape(n, DIM)


def shape(token: str) -> str:
    first = token[0]
    if not (first.isalnum() or first == "_"):
        return f"\0mark{first}{min(len(token), 4)}"
    case = "digit" if any(c.isdigit() for c in token) else "upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"
    return f"\0{case}{min(len(token) // 4, 4)}"


def measures(tokens: list[str]) -> list[str]:
    """Words for the length of a text and for how often its words repeat, anywhere and at once."""
    n = len(tokens)
    again = sum(map(operator.eq, tokens, tokens[1:]))
    return [f"\0length{n.bit_length()}", f"\0again{int(20 * again / n) if n else 0}", f"\0distinct{min(n.bit_length(), 8)}:{int(12 * len(set(tokens)) / n) if n else 0}"]


class Model:
    """Vectors, network and temperature; everything that scoring needs."""

    def __init__(self, rows: dict[str, int], vectors: np.ndarray, layers: list[np.ndarray] | None, temperature: float, prior: float):
        self.rows, self.vectors, self.layers, self.temperature, self.prior = rows, vectors, layers, temperature, prior
        self._ready()

    def _ready(self):
        unknown = len(self.rows)
        get = self.rows.get
        self._row = Cache(lambda token: (get(token.lower(), unknown), get(shape(token), unknown)), 100_000)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_row"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def pooled(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        extra = self.vectors[[self.rows.get(w, len(self.rows)) for w in measures(tokens)]].sum(0)
        if not tokens:
            return np.concatenate([np.zeros(2 * DIM, dtype=np.float32), extra])
        rows = np.array(list(map(self._row.__getitem__, tokens)))
        return np.concatenate([self.vectors[rows[:, 0]].mean(0), self.vectors[rows[:, 1]].mean(0), extra])

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, mean, scale = self.layers
        return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        z = self.logit(np.array([self.pooled(t) for t in texts])) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _streams(text: str, shapes: Cache) -> tuple[list[str], list[str], list[str]]:
    """Words, shapes and measures of a text."""
    tokens = _TOKEN.findall(text)
    return [t.lower() for t in tokens], [shapes[t] for t in tokens], measures(tokens)


def word_counts(texts) -> Counter:
    shapes, counts = Cache(shape, 40_000), Counter()
    for text in texts:
        for part in _streams(text, shapes):
            counts.update(part)
    return counts


def neighbour_sums(texts, rows: dict[str, int]) -> np.ndarray:
    """For every known word, and unknown ones as one, the sum of the index vectors of its neighbours in these texts."""
    shapes, unknown = Cache(shape, 40_000), len(rows)
    places, values = _index_table(rows)
    context = np.zeros((unknown + 1, DIM), dtype=np.float32)
    ids: list[int] = []

    def add():
        at = np.array(ids, dtype=np.int64)
        for d in range(1, WINDOW + 1):
            for a, b in ((at[d:], at[:-d]), (at[:-d], at[d:])):
                seen, of = np.unique(a, return_inverse=True)
                context[seen] += _sums(of, places[b], values[b], len(seen)).astype(np.float32)
        ids.clear()

    for text in texts:
        for part in _streams(text, shapes)[:2]:
            ids.extend(rows.get(w, unknown) for w in part)
            ids.extend([unknown] * WINDOW)  # neighbours are of one text
        if len(ids) > 200_000:
            add()
    add()
    return context


def _index_table(rows: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the index vectors by row; those of unknown words are zero."""
    places, values = index_vectors(list(rows))
    return np.vstack([places, np.zeros((1, NONZERO), dtype=np.int64)]), np.vstack([values, np.zeros((1, NONZERO))])


def vocabulary(counts) -> dict[str, int]:
    """Row of each word of (word, count) that the texts have MIN_COUNT times."""
    return {w: k for k, w in enumerate(sorted(w for w, n in counts if n >= MIN_COUNT))}


def word_vectors(rows: dict[str, int], context: np.ndarray) -> np.ndarray:
    """A vector for each row, the last one, of unknown words, being zero."""
    places, values = _index_table(rows)
    index = _sums(np.arange(len(rows) + 1), places, values, len(rows) + 1).astype(np.float32)
    vectors = index + context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    vectors[-1] = 0
    return vectors


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> list[np.ndarray]:
    """Adam on the cross entropy, classes weighted alike."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 128):
            at = order[k : k + 128]
            h = np.maximum(x[at] @ params[0] + params[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - y[at]) * weight[at] / len(at)
            gh = np.outer(g, params[2]) * (h > 0)
            grads = [x[at].T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] = params[i] - 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return [*params, mean, scale]


def temperature_of(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross entropy on these logits."""
    grid = np.geomspace(0.25, 16, 61)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def trained(rows: dict[str, int], vectors: np.ndarray, x: np.ndarray, labels: list[int]) -> Model:
    """The model of these vectors; x: the vector of each labelled row."""
    y = np.array(labels, dtype=float)
    model = Model(rows, vectors, None, 1.0, float(y.mean()))
    order = np.random.default_rng(3).permutation(len(y))
    cut = max(1, len(y) // 5)
    aside, rest = order[:cut], order[cut:]
    if len(set(y[rest])) < 2:
        rest = order
    model.layers = train_network(x[rest], y[rest])
    model.temperature = temperature_of(model.logit(x[aside]), y[aside])
    return model


def _without_network(labels: list[int]) -> Model:
    return Model({}, np.zeros((1, DIM), dtype=np.float32), None, 1.0, sum(labels) / len(labels) if labels else 0.5)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fits on texts at hand."""
    if len(set(labels)) < 2:
        return _without_network(labels)
    rows = vocabulary(word_counts(texts).items())
    vectors = word_vectors(rows, neighbour_sums(texts, rows))
    model = Model(rows, vectors, None, 1.0, 0.5)
    return trained(rows, vectors, np.array([model.pooled(t) for t in texts], dtype=float), labels)


def fit_on_tables(docs: DataFrame, labels: DataFrame, learn_from, rows_per_class: int = 2000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a sample of the labelled rows for which the column ``learn_from`` holds; what is gathered is bounded by the parameter."""
    spark = docs.sparkSession
    known = labels.filter(learn_from & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.withColumn("_u", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_label") == 1, min(1.0, rows_per_class / max(1, counts.get(1, 1)))).otherwise(min(1.0, rows_per_class / max(1, counts.get(0, 1))))
    sample = known.filter(F.col("_u") < share).groupBy("_id").agg(F.max("_label").alias("_label"))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter(F.col("_text").isNotNull()).join(F.broadcast(sample), "_id").select("_id", "_text", "_label")
    found = written(found.repartition(FIT_PARTS, "_id"))
    seen = [r["_label"] for r in found.select("_label").collect()]
    if len(set(seen)) < 2:
        return _without_network(seen)

    def texts(batches):
        for part in slices(batches, 4 << 20, column=0):
            yield from part.column(0).to_pylist()

    def count(batches):
        active("quality")
        for part in slices(batches, 4 << 20, column=0):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*word_counts(part.column(0).to_pylist()).items(), strict=True)] or [pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "n"])

    often = found.select("_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    rows = vocabulary((r["word"], r["n"]) for r in often.toLocalIterator())
    sent = spark.sparkContext.broadcast(pickle.dumps(rows))

    def neighbours(batches):
        active("quality")
        sums = neighbour_sums(texts(batches), pickle.loads(sent.value))
        for k in range(0, len(sums), 4096):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sums[k : k + 4096].tobytes()], pa.binary())], ["at", "sums"])

    context = np.zeros((len(rows) + 1, DIM), dtype=np.float32)
    for r in found.select("_text").mapInArrow(neighbours, "at long, sums binary").toLocalIterator():
        part = np.frombuffer(r["sums"], dtype=np.float32).reshape(-1, DIM)
        context[r["at"] : r["at"] + len(part)] += part
    sent.unpersist()
    vectors = word_vectors(rows, context)
    del context
    pooling = spark.sparkContext.broadcast(pickle.dumps(Model(rows, vectors, None, 1.0, 0.5)))

    def pooled(batches):
        active("quality")
        model = pickle.loads(pooling.value)
        for part in slices(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([model.pooled(t).astype(np.float64).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["_id", "_label", "x"])

    schema = StructType([found.schema["_id"], found.schema["_label"], StructField("x", BinaryType())])
    of = sorted((r["_id"], r["_label"], bytes(r["x"])) for r in found.mapInArrow(pooled, schema).toLocalIterator())
    pooling.unpersist()
    return trained(rows, vectors, np.array([np.frombuffer(x) for *_, x in of]), [y for _, y, _ in of])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        active("quality")
        model = pickle.loads(sent.value)
        for part in slices(batches, 4 << 20):
            yield record_batch(OUT, part.column(0), pa.array(model.score(part.column(1).to_pylist())))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
