"""Files that the engine reads and writes: JSON arrays, JSON lines, profiles, settings, binary files, the document index."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.order import checkpointed, latest

NOTICE = "title string, url string, date string, body string, category string"
QA = "question string, answer string, type string, source_span string, notice_id bigint, notice_title string"
JUDGED = f"{QA}, hallucination boolean, hallucinated_claims array<string>, inferred_claims array<string>, hall_reason string, judge_score int, judge_reason string, unchecked boolean, needs_review boolean"
PAIR = "query string, positive string"
PROFILE = "name string, college string, track string, grade string, interests array<string>"
INDEX = "doc_id string, embedding array<float>, document string, title string, url string, date string, category string"


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold a JSON array; a missing path is an empty table."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("multiLine", True).json(path))


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, required: str | None = None) -> DataFrame:
    """JSON lines. strict: a malformed line is an error; else it is left out, as are lines without the required key."""
    out = _or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path))
    return out.filter(F.col(required).isNotNull()) if required else out


def write_json(df: DataFrame, path: str) -> None:
    """Replaces what was there by files that each hold a JSON array, one for each task; nulls are written, and no character is escaped that need not be."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def arrays(batches):
        last = None  # a row waits until it is known whether another one follows
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out.append("[" if last is None else f"{last},")
                last = value
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]"] if last is None else [last, "]"], pa.string())], names=["value"])

    lines.mapInArrow(arrays, "value string").write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder in any store that Spark knows; whether there was one."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_profile(profile: DataFrame, path: str) -> None:
    """The one row of a profile, in the place of the one before."""
    write_json(profile.limit(1).coalesce(1), path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The stored profile, or no row."""
    return read_json_array(spark, path, PROFILE)


def delete_profile(spark: SparkSession, path: str) -> bool:
    return _remove(spark, path)


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY=value lines: blank lines and those that begin with # are left out, the first value of a key counts. A small file, read as a whole."""
    lines = _or_empty(spark, "value string", lambda: spark.read.text(path, wholetext=True)).collect()
    pairs = [line.partition("=") for r in lines for line in r[0].splitlines() if line.strip() and not line.strip().startswith("#") and "=" in line]
    return {key.strip(): value.strip() for key, _, value in reversed(pairs)}


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of images, PDFs and other files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def as_base64(files: DataFrame) -> DataFrame:
    """(path, base64) without line breaks."""
    return files.select("path", F.regexp_replace(F.base64("content"), r"[\r\n]", "").alias("base64"))


def index_records(notices: DataFrame, embed=None) -> DataFrame:
    """Index records of notices: id by the URL, text of title and body. embed: a column function of the text."""
    document = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    vector = embed(document) if embed else F.lit(None).cast("array<float>")
    return notices.select(F.md5("url").alias("doc_id"), vector.alias("embedding"), document.alias("document"), "title", "url", "date", "category")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index; an empty one if there is none."""
    return _or_empty(spark, INDEX, lambda: spark.read.schema(INDEX).parquet(path))


def ensure_index(spark: SparkSession, path: str, notices: DataFrame, embed=None) -> DataFrame:
    """The stored index; it is made of the notices only where it is empty. Later notices go in by upsert()."""
    if open_index(spark, path).isEmpty():
        index_records(notices, embed).write.mode("overwrite").parquet(path)
    return open_index(spark, path)


def upsert(index: DataFrame, records: DataFrame, key: str = "doc_id", ordinal: str | None = None) -> DataFrame:
    """The index with the records put in: those with a known id replace it, the last of a batch wins."""
    place = F.col(ordinal).cast("long") if ordinal else F.lit(0).cast("long")
    old = index.withColumn("_version", F.lit(0)).withColumn("_at", F.lit(0).cast("long"))
    new = records.withColumn("_version", F.lit(1)).withColumn("_at", place)
    return latest(old.unionByName(new.select(old.columns)), key, "_version", "_at").select(index.columns)


def replace_partitions(rows: DataFrame, path: str, partition: str, touched: list) -> None:
    """Puts the rows in the place of what these partitions hold; a partition that gets none is removed, and the files of all others stay.

    The rows, which may be made of what is replaced, are written once, beside what is there, and then moved. A run that is stopped
    while partitions are moved leaves some old and some new; run again with the same rows it ends with all new.
    """
    spark = rows.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"  # readers pass over names that begin so
    rows.hint("rebalance", F.col(partition)).write.option("compression", "zstd").partitionBy(partition).parquet(staged)
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    made = {f.getPath().getName() for f in fs.listStatus(where(staged)) if f.isDirectory()}  # a name for each partition
    for name in sorted(made | {f"{partition}={value}" for value in touched}):
        _remove(spark, f"{path}/{name}")
        if name in made and not fs.rename(where(f"{staged}/{name}"), where(f"{path}/{name}")):
            raise OSError(f"{staged}/{name} could not be moved")
    _remove(spark, staged)


class BucketedIndex:
    """An index whose rows lie in partitions by a hash of their key, so that an upsert rewrites only the partitions its records fall in.

    The number of buckets is part of the layout: an index is opened with the number it was made with. A null key is a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = INDEX, key: str = "doc_id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """The index, with the column ``bucket``; a filter on it reaches the files. An empty one if there is none."""
        schema = f"{self.schema}, bucket int"
        return _or_empty(self.spark, schema, lambda: self.spark.read.schema(schema).parquet(self.path))

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows with one of these keys; only their buckets are read."""
        wanted = keys.select(self.key).distinct().withColumn("bucket", self.bucket())
        touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
        return self.rows().filter(F.col("bucket").isin(touched)).join(wanted, ["bucket", self.key], "left_semi")

    def upsert(self, records: DataFrame, ordinal: str | None = None) -> list[int]:
        """Puts records in: those with a known key replace it, the last of a batch wins. Returns the buckets that were rewritten."""
        names = self.rows().drop("bucket").columns
        new = checkpointed(records.select(*names, *([F.col(ordinal).alias("_ordinal")] if ordinal else [])).withColumn("bucket", self.bucket()))
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # as many as there are buckets at most
        old = self.rows().filter(F.col("bucket").isin(touched))
        if ordinal:
            old = old.withColumn("_ordinal", F.lit(None).cast(new.schema["_ordinal"].dataType))
        merged = upsert(old, new, self.key, "_ordinal" if ordinal else None).select(*names, "bucket")
        replace_partitions(merged, self.path, "bucket", touched)
        return touched

    def remove(self, keys: DataFrame) -> list[int]:
        """Takes the rows with these keys out; returns the buckets that were rewritten."""
        gone = checkpointed(keys.select(self.key).distinct().withColumn("bucket", self.bucket()))
        touched = sorted(r[0] for r in gone.select("bucket").distinct().collect())
        left = self.rows().filter(F.col("bucket").isin(touched)).join(gone, ["bucket", self.key], "left_anti")
        replace_partitions(left.select(*self.rows().columns), self.path, "bucket", touched)
        return touched


def write_co_located(rows: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Writes rows as a table bucketed and sorted by the key. Tables of one key and number of buckets are joined on it without a shuffle."""
    if rows.sparkSession.conf.get("spark.sql.sources.bucketing.enabled") == "false":
        raise RuntimeError("bucketing is switched off in this session")
    name = f"tesserae_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, key)  # a file for each bucket
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return rows.sparkSession.table(name)


def open_co_located(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A table that write_co_located() wrote, in another session."""
    name = f"tesserae_{uuid.uuid4().hex}"
    quoted = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    return spark.table(name)


def scan(index: DataFrame, category: str | None = None, everything: str = "all") -> DataFrame:
    """The index, or one category of it; the filter reaches the files."""
    return index if not category or category == everything else index.filter(F.col("category") == category)


def unseen(rows: DataFrame, done: DataFrame, key: str, ordinal: str | None = None) -> DataFrame:
    """Rows whose key is not done yet; with an ordinal only the first row of each key."""
    new = rows.join(done.select(key).distinct(), key, "left_anti").select(rows.columns)
    if ordinal is None:
        return new
    return new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.col(ordinal)).alias("_r")).select("_r.*").select(rows.columns)
