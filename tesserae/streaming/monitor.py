"""Streams of new items: first sight of each key, monitors that note or index what is new, and crawls that go on where they were."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.rules import Rules, infer_category
from tesserae.sources.files import INDEX, BucketedIndex, index_records, unseen


def first_seen(stream: DataFrame, key: str, time_col: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark; a time without zone is taken as a timestamp."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs over what there is, writes it to files at the path and reads them."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def in_steps(stream: DataFrame, work, out_path: str, checkpoint: str):
    """Writes work(batch, epoch) of every batch to out_path as JSON lines; a batch that is run again replaces its own files, so a job that was stopped goes on where it was and loses and repeats nothing."""

    def step(batch: DataFrame, epoch: int) -> None:
        work(batch, epoch).write.mode("overwrite").json(f"{out_path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monitor(spark: SparkSession, stream: DataFrame, seen_path: str, out_path: str, checkpoint: str, key: str = "url", order: str = "date", baseline: int = 50):
    """Writes unseen items to out_path, the first row in the given order of each key. The first run only notes the newest ``baseline`` keys as seen.

    Both folders hold a folder for each batch, which a batch that is run again replaces.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        seen_type = dict(batch.dtypes)[key]
        try:
            seen = spark.read.schema(f"{key} {seen_type}, epoch long").json(seen_path).filter(F.col("epoch") < epoch)
            known = seen.select(key)
            first = known.isEmpty()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            first = True
        if first:
            batch.orderBy(F.desc(order), key).limit(baseline).select(key).write.mode("overwrite").json(f"{seen_path}/epoch={epoch}")
            return
        new = unseen(batch, known, key, order).persist()
        new.write.mode("overwrite").json(f"{out_path}/epoch={epoch}")
        new.select(key).write.mode("overwrite").json(f"{seen_path}/epoch={epoch}")
        new.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The index that a monitor keeps: records with the batch that brought them.
MONITORED = f"{INDEX}, epoch long"


def monitored_index(spark: SparkSession, path: str, buckets: int = 64) -> BucketedIndex:
    return BucketedIndex(spark, path, MONITORED, "doc_id", buckets)


def index_new(stream: DataFrame, index: BucketedIndex, rules: Rules, checkpoint: str, embed=None, order: str = "date", after=None):
    """Puts notices (title, url, date, body) of a stream into the index as they come: each gets its category by the rules and its vector by ``embed``.

    What the index has from earlier batches stays as it is; of several new notices of one URL the first in the given order
    is taken. A batch looks only at the buckets of its own keys, and rewrites only those that get new rows. Records bear the
    number of their batch: a batch that runs again, after a stop at any point, takes its own records for new and so writes
    the same rows once more. after(records, epoch) is called with what a batch has put in, as for messages; it may see a batch twice.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        first = batch.filter("url is not null").groupBy("url").agg(F.min_by(F.struct(*batch.columns), F.struct(order, F.xxhash64(*batch.columns))).alias("r")).select("r.*")
        records = index_records(first.withColumn("category", infer_category(rules, "title", "body")), embed).withColumn("epoch", F.lit(epoch).cast("long"))
        known = index.among(records).filter(F.col("epoch") < epoch).select("doc_id")
        index.upsert(records.join(known, "doc_id", "left_anti"))
        if after is not None:
            after(index.among(records).filter(F.col("epoch") == epoch), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawl_on(stream: DataFrame, out_path: str, state_path: str, checkpoint: str, since: str, date: str = "date", key: str = "url", order: tuple[str, ...] = ("page", "position")):
    """Takes the items of listing pages, which come newest first, until the first one dated before ``since``, and writes them batch by batch.

    Whether the end was reached is kept beside what was written, a folder for each batch, which a batch that runs again
    replaces: a crawl that was stopped goes on with the next batch, and one that has ended takes nothing more, whoever
    starts it again. Dates are compared as text; an item without one does not end the crawl. A key that an earlier batch took is left out, and of
    several of one batch the first counts.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = F.struct(*order)
        ended = _by_epoch(spark, state_path, "ended boolean", epoch).filter("ended").limit(1).count() > 0
        old = batch.filter(F.col(date) < since).agg(F.min(at).alias("_end"))
        taken = batch.join(F.broadcast(old)).filter(F.lit(not ended) & (F.col("_end").isNull() | (at < F.col("_end")))).drop("_end")
        taken = taken.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
        done = _by_epoch(spark, out_path, f"{key} string", epoch).select(key)
        taken.join(done, key, "left_anti").select(*batch.columns).write.mode("overwrite").json(f"{out_path}/epoch={epoch}")
        old.select((F.col("_end").isNotNull() | F.lit(ended)).alias("ended")).write.mode("overwrite").json(f"{state_path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _by_epoch(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What batches before this one have written; nothing before the first."""
    try:
        return spark.read.schema(f"{schema}, epoch long").json(path).filter(F.col("epoch") < before)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, epoch long")
