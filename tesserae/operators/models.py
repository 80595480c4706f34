"""Model calls behind small interfaces; texts are encoded and tokenised by hashing words where no model is given.

A model is an object whose ``load()`` gives a function over lists of strings; it is loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T

_LOADED: dict = {}
#: Tries of a model that is limited in its rate.
TRIES = 5
#: Texts that are tokenized at once.
TEXTS = 64


def loaded(model):
    key = (type(model).__name__, repr(model.__dict__))
    if key not in _LOADED:
        _LOADED[key] = model.load()
    return _LOADED[key]


class HashEmbedder:
    """Stand-in encoder: signed feature hashing of words, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def load(self):
        def encode(texts):
            out = np.zeros((len(texts), self.dim), dtype=np.float32)
            for row, text in zip(out, texts, strict=True):
                for word in re.findall(r"\w+", (text or "").lower()):
                    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                    row[h % self.dim] += 1 if h >> 63 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return encode


def embed(text: Column | str, model=None) -> Column:
    model = model or HashEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: pd.Series) -> pd.Series:
        return pd.Series(list(loaded(model)(batches.tolist())))

    return run(text)


def replies(model, prompts: list, sleep=time.sleep) -> list:
    """The replies to a batch. A rate limit (429) is waited for, as long as it says, in five tries at most; other errors are raised."""
    for attempt in range(TRIES):
        try:
            return list(loaded(model)(prompts))
        except Exception as e:
            if "429" not in str(e):
                raise
            if attempt == TRIES - 1:
                raise RuntimeError(f"no reply in {TRIES} tries") from e
            said = re.search(T.RETRY, str(e))
            sleep(int(said.group(1)) + 2 if said else 60)  # as T.retry_delay


def ask(prompt: Column, model, otherwise=None) -> Column:
    """The model's reply to each prompt. An error, after the tries of replies(), ends the query; where ``otherwise`` is given,
    a function of the error, the prompts of a batch that failed are sent one by one and its result stands for those that
    fail again. Filter rows before: a Python function runs for every row it gets."""

    def one(prompt):
        try:
            return replies(model, [prompt])[0]
        except Exception as e:  # noqa: BLE001
            return otherwise(e)

    @F.pandas_udf("string")
    def run(batches: pd.Series) -> pd.Series:
        try:
            return pd.Series(replies(model, batches.tolist()), dtype=object)
        except Exception:
            if otherwise is None:
                raise
            return pd.Series([one(p) for p in batches], dtype=object)

    return run(prompt)


def _nothing(error) -> str:
    return ""


def summarize(title: Column, body: Column, model=None) -> Column:
    """The model's summary of title and the first 512 characters; without a model or a reply the first sentences."""
    plain = T.extractive_summary(body)
    if model is None:
        return plain
    return F.coalesce(F.nullif(ask(F.concat(title, F.lit("\n\n"), F.substring(body, 1, 512)), model, otherwise=_nothing), F.lit("")), plain)


def classify(title: Column, body: Column, rules: Column, labels: list[str], model=None) -> Column:
    """The model's label of title and the first 200 characters, where it is among the labels; else by rules."""
    if model is None:
        return rules
    said = ask(F.concat(title, F.lit(" "), F.substring(body, 1, 200)), model, otherwise=_nothing)
    return F.when(said.isin(*labels), said).otherwise(F.when(said == "", rules).otherwise("other"))


class HashTokenizer:
    """Stand-in tokenizer: a hash of each word, between 2 and ``size``; 0 pads, 1 ends a text."""

    def __init__(self, size: int = 1 << 15):
        self.size = size

    def load(self):
        return lambda texts: [[2 + int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % (self.size - 2) for w in re.findall(r"\w+", (t or "").lower())] + [1] for t in texts]


def tokenized(rows: DataFrame, tokenizer=None, text_col: str = "text", length: int = 256, pad: int = 0) -> DataFrame:
    """The rows with input_ids and attention_mask of exactly this length in the place of the text: longer ones are cut, shorter ones padded."""
    tokenizer = tokenizer or HashTokenizer()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        out = []  # of a few texts at a time the tokens are Python's numbers; none is kept beyond the length
        for k in range(0, len(texts), TEXTS):
            out += [np.asarray(x[:length], dtype=np.int32) for x in loaded(tokenizer)(texts.iloc[k : k + TEXTS].tolist())]
        return pd.Series(out, dtype=object)

    found = F.slice(ids(F.col(text_col)), 1, length)
    out = rows.withColumn("_ids", found).drop(text_col)
    fill = F.array_repeat(F.lit(pad), F.lit(length) - F.size("_ids"))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), F.lit(length) - F.size("_ids")))
    return out.withColumn("input_ids", F.concat("_ids", fill)).withColumn("attention_mask", mask).drop("_ids")


def train_text_classifier(rows: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 14):
    """Spark ML pipeline over hashed terms; save it with .write().overwrite().save(path)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol=text_col, outputCol="words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=1)
    counts = HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True)
    return Pipeline(stages=[words, counts, LogisticRegression(labelCol=label_col, maxIter=20, regParam=0.01)]).fit(rows)


def save_classifier(model, labels: list[str], path: str) -> None:
    """A fitted pipeline and the names of its labels, in the place of what was there."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(list(enumerate(labels)), "label int, category string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load_classifier(spark: SparkSession, path: str):
    """(pipeline, labels) that save_classifier() has written; None if there is none, so that rules decide."""
    from pyspark.ml import PipelineModel

    try:
        rows = spark.read.schema("label int, category string").json(f"{path}/labels").collect()  # a row for each label
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return PipelineModel.load(f"{path}/model"), [r["category"] for r in sorted(rows, key=lambda r: r["label"])]


def predicted_category(rows: DataFrame, classifier, rules: Column, text_col: str = "text") -> DataFrame:
    """Adds category: of the classifier's labels, or by rules where there is no classifier."""
    if classifier is None:
        return rows.withColumn("category", rules)
    model, labels = classifier
    kept = rows.columns
    names = F.array(*[F.lit(x) for x in labels])
    return model.transform(rows).select(*kept, F.coalesce(F.try_element_at(names, F.col("prediction").cast("int") + 1), F.lit("other")).alias("category"))


def tuned_or_base(spark: SparkSession, path: str, tuned, base):
    """tuned(path) where the path holds anything, else base(): a fine-tuned model goes before the one it was made of."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return tuned(path) if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else base()
