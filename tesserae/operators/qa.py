"""Question-answer data: seeds, three-stage judging, verdicts and their statistics.

Model calls are made on filtered rows and the branches are put together again, so a row that one stage settles is never
sent to the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators.models import ask
from tesserae.operators.order import checkpointed

VERIFIED = "results array<struct<claim:string,status:string,evidence:string>>, hallucination boolean, hallucinated_claims array<string>, reason string"
PASS_SCORE, REVIEW_SHARE = 4, 0.2


def format_notice(title: Column, date: Column, category: Column | None, body: Column) -> Column:
    lines = [F.concat(F.lit("Title: "), title), F.concat(F.lit("Date: "), date)]
    if category is not None:
        lines.append(F.concat(F.lit("Category: "), category))
    return F.concat_ws("\n", *lines, F.concat(F.lit("Body: "), body))


def first_long(notices: DataFrame, *order: str, n: int = 3, min_chars: int = 300) -> DataFrame:
    """The first n notices with a body of more than min_chars."""
    return notices.filter(F.length(F.coalesce("body", F.lit(""))) > min_chars).orderBy(*order).limit(n)


def seed_questions(notices: DataFrame, model=None, min_chars: int = 300) -> DataFrame:
    """notices (notice_id, title, body) of more than min_chars to (notice_id, notice_title, question, answer, type, source_span)."""
    rows = notices.filter(F.length(F.coalesce("body", F.lit(""))) > min_chars).withColumn("n", T.qa_counts("body"))
    if model is not None:
        reply = ask(F.concat(F.lit("seed\n"), F.col("n.well").cast("string"), F.lit("\x1f"), "body"), model)
        made = T.parsed_json(reply, "array<struct<question:string,answer:string,type:string,source_span:string>>")
    else:
        made = F.transform(F.slice(T.sentences("body"), 1, 5), lambda s, i: F.struct(F.concat(F.lit("What about point "), (i + 1).cast("string"), F.lit("?")).alias("question"), s.alias("answer"), F.when(i < F.col("n.well"), "well").otherwise("user").alias("type"), s.alias("source_span")))
        made = F.slice(made, F.lit(1), F.col("n.well") + F.col("n.user"))
    return rows.select("notice_id", F.col("title").alias("notice_title"), F.explode(made).alias("q")).select("notice_id", "notice_title", "q.*")


def seed_table(spark: SparkSession, make, name: str = "seed_pairs") -> str:
    """Registers a table function ``name(title, body)`` over make(title, body), and returns its name.

    make gives (question, answer, type, source_span) one after another, and is called once for a notice, which is at hand
    in Python only while its pairs are made; what it cannot make pairs of gives no row. In SQL: SELECT ... FROM notices, LATERAL seed_pairs(title, body).
    """

    class SeedPairs:
        def eval(self, title: str, body: str):
            for pair in make(title or "", body or ""):
                yield tuple(pair)

    spark.udtf.register(name, F.udtf(SeedPairs, returnType="question string, answer string, type string, source_span string", useArrow=True))
    return name


def seed_pairs(notices: DataFrame, make, min_chars: int = 300) -> DataFrame:
    """notices (notice_id, title, body) of more than min_chars to (notice_id, notice_title, question, answer, type, source_span), by a table function in a lateral join."""
    spark, view = notices.sparkSession, f"notices_{uuid.uuid4().hex}"
    name = seed_table(spark, make, f"seed_pairs_{uuid.uuid4().hex}")
    notices.filter(F.length(F.coalesce("body", F.lit(""))) > min_chars).select("notice_id", "title", "body").createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT n.notice_id, n.title AS notice_title, s.question, s.answer, s.type, s.source_span FROM {view} n, LATERAL {name}(n.title, n.body) s")
    finally:
        spark.catalog.dropTempView(view)


def judge(pairs: DataFrame, model) -> DataFrame:
    """pairs (…, question, answer, notice) with hallucination, hallucinated_claims, inferred_claims, hall_reason, judge_score, judge_reason, unchecked, needs_review."""
    own = pairs.columns
    none = F.array().cast("array<string>")
    claims = F.coalesce(T.parsed_json(ask(F.concat(F.lit("claims\n"), "answer"), model), "array<string>"), none)
    one = checkpointed(pairs.withColumn("claims", claims))
    checked = one.filter(F.size("claims") > 0)
    verified = F.from_json(T.repaired_json(ask(F.concat(F.lit("verify\n"), "answer", F.lit("\x1f"), "notice", F.lit("\x1f"), T.numbered("claims")), model)), VERIFIED)
    checked = checkpointed(checked.withColumn("v", verified)).select(
        *own,
        F.coalesce("v.hallucination", F.lit(False)).alias("hallucination"),
        F.coalesce("v.hallucinated_claims", none).alias("hallucinated_claims"),
        F.coalesce(F.transform(F.filter("v.results", lambda r: r["status"] == "inferred"), lambda r: r["claim"]), none).alias("inferred_claims"),
        F.coalesce("v.reason", F.lit("")).alias("hall_reason"),
        F.size(F.coalesce("v.results", F.array().cast("array<struct<claim:string,status:string,evidence:string>>"))).alias("n_results"),
        F.lit(False).alias("unchecked"),
    )
    bare = one.filter(F.size("claims") == 0).select(*own, F.lit(False).alias("hallucination"), none.alias("hallucinated_claims"), none.alias("inferred_claims"), F.lit("no factual claim").alias("hall_reason"), F.lit(0).alias("n_results"), F.lit(True).alias("unchecked"))
    both = checked.unionByName(bare).withColumn("needs_review", F.coalesce(F.try_divide(F.size("inferred_claims").cast("double"), F.col("n_results")) > REVIEW_SHARE, F.lit(False))).drop("n_results")
    wrong = both.filter("hallucination").withColumn("judge_score", F.lit(0)).withColumn("judge_reason", F.concat(F.lit("[HALLUCINATION] "), "hall_reason"))
    right = both.filter("not hallucination")
    quality = T.parsed_json(ask(F.concat(F.lit("quality\n"), "question", F.lit("\x1f"), "answer", F.lit("\x1f"), "notice"), model), "score string, reason string")
    right = right.withColumn("q", quality).withColumn("judge_score", F.coalesce(F.expr("try_cast(trim(q.score) as int)"), F.lit(0))).withColumn("judge_reason", F.coalesce("q.reason", F.lit(""))).drop("q")
    right = right.withColumn("hall_reason", F.lit(None).cast("string")).withColumn("hallucinated_claims", none)
    return wrong.unionByName(right)


def verdict(hallucination: Column, score: Column) -> Column:
    return F.when(hallucination, "hallucinated").when(score >= PASS_SCORE, "passed").otherwise("low")


def verdict_stats(rows: DataFrame, verdict_col: str = "verdict", skipped: int = 0) -> DataFrame:
    """Counts and percentages with one decimal. skipped: rows judged by earlier runs, which count in the total."""
    v = F.col(verdict_col)
    counts = rows.agg(F.count_if(v == "passed").alias("passed"), F.count_if(v == "hallucinated").alias("hallucinated"), F.count_if(v == "low").alias("low"), (F.count("*") + F.lit(skipped)).alias("total"))
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.col(c) * 100.0, F.col("total")), 1), F.lit(0.0)).alias(f"{c}_rate")
    return counts.select("*", rate("passed"), rate("hallucinated"), rate("low"))


def training_pairs(judged: DataFrame) -> DataFrame:
    """(query, positive) of what passed."""
    return judged.filter(verdict(F.col("hallucination"), F.col("judge_score")) == "passed").select(F.col("question").alias("query"), F.col("answer").alias("positive"))
