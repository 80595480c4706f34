"""Training data for encoders and classifiers, guards, evaluation, and a driver for trainers that are brought along.

A trainer is an object with ``train_rows(rows, path)``, which gets the table of its rows and leaves its model at the path: those of
this package (contrastive.ContrastiveTrainer, TextTrainer) work where the rows are. One that is brought along and needs to see
batches one after another has ``train(batches, path)`` instead, and gets an iterator over pandas frames; rows then stream through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import order
from tesserae.operators.models import save_classifier, train_text_classifier
from tesserae.operators.rules import label_index

#: Rows that training and evaluation need.
LEAST_TRAIN, LEAST_EVAL = 10, 5


def enough(rows: DataFrame, least: int) -> bool:
    """Whether there are at least so many rows; looks at no more than that."""
    return rows.limit(least).count() >= least


def accuracy(rows: DataFrame, label: Column | str = "label", prediction: Column | str = "prediction") -> DataFrame:
    """One row (n, accuracy): the share of predictions that equal the label, 4 decimals; null without rows. A null prediction is wrong."""
    right = F.coalesce(T.col(label).eqNullSafe(T.col(prediction)).cast("double"), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(right), 4).alias("accuracy"))


def classify_dataset(notices: DataFrame, labels: list[str], chars: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """(text, label), after the columns to keep, of notices (title, body, category) whose category is among the labels."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("body", F.lit("")), 1, chars))
    return notices.filter(F.col("category").isin(*labels)).select(*keep, text.alias("text"), label_index("category", labels).alias("label"))


def corpus_ids(pairs: DataFrame, positive: str = "positive", ordinal: str = "position") -> DataFrame:
    """The pairs with corpus_id: the place of their positive among the distinct ones, in the order of first occurrence. Null positives have none."""
    first = pairs.filter(F.col(positive).isNotNull()).groupBy(positive).agg(F.min(ordinal).alias("_first"))
    placed = order.with_position(first, "_first", positive, name="corpus_id")
    return pairs.join(placed.select(positive, "corpus_id"), positive, "left")


def batches(rows: DataFrame, size: int = 64) -> Iterator:
    """pandas frames of rows of one ``batch`` after another, read partition by partition; the driver holds one partition."""
    import pandas as pd

    held = []
    ordered = rows.repartitionByRange("batch").sortWithinPartitions("batch", "position")
    for row in ordered.toLocalIterator():
        if held and held[-1]["batch"] != row["batch"]:
            yield pd.DataFrame([r.asDict() for r in held])
            held = []
        held.append(row)
    if held:
        yield pd.DataFrame([r.asDict() for r in held])


def _train(trainer, rows: DataFrame, path: str) -> None:
    if hasattr(trainer, "train_rows"):
        trainer.train_rows(rows, path)
    else:
        trainer.train(batches(rows), path)


class TextTrainer:
    """Trains and saves the text classifier of models.py on rows (text, label); labels: their names."""

    def __init__(self, labels: list[str], features: int = 1 << 14):
        self.labels, self.features = labels, features

    def train_rows(self, rows: DataFrame, path: str) -> None:
        save_classifier(train_text_classifier(rows, features=self.features), self.labels, path)


def finetune_all(notices: DataFrame, pairs: DataFrame, labels: list[str], embedding, classifier, path: str, seed: str = "42") -> dict[str, str]:
    """Trains an encoder on pairs (query, positive) and then a classifier on notices (title, body, category).

    Without pairs nothing is trained; a set of less than LEAST_TRAIN rows is left out. Pairs go to the encoder in batches in
    which equal positives are apart, as others of a batch count as wrong answers. Returns what became of each.
    """
    if not enough(pairs, 1):
        return {"embedding": "no pairs", "classifier": "no pairs"}
    done = {}
    if enough(pairs, LEAST_TRAIN):
        keyed = pairs.withColumn("_key", F.md5(F.concat_ws("\x1f", "query", "positive")))
        _train(embedding, order.round_robin(keyed, "positive", "_key").drop("_key"), f"{path}/embedding")
        done["embedding"] = "trained"
    else:
        done["embedding"] = "too few rows"
    rows = classify_dataset(notices, labels)
    if enough(rows, LEAST_TRAIN):
        split = order.stratified_split(rows.withColumn("_key", F.md5("text")), "label", "_key", seed=seed).filter("split = 'train'")
        dealt = order.with_position(split, "_key").withColumn("batch", F.floor(F.col("position") / 64)).drop("_key", "split")
        _train(classifier, dealt, f"{path}/classifier")
        done["classifier"] = "trained"
    else:
        done["classifier"] = "too few rows"
    return done
