"""Data-quality checks; each yields rows (validation, success, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchpulse.functions.columns import as_date, as_timestamp
from searchpulse.schemas import schema_differences
from searchpulse.sources.files import list_files

CHECK_COLUMNS = ["validation", "success", "details"]


def _check(df: DataFrame, name: str, success, details) -> DataFrame:
    return df.select(F.lit(name).alias("validation"), success.alias("success"), details.alias("details"))


def check_has_data(df: DataFrame, name: str = "has_data") -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    return _check(n, name, F.col("n") > 0, F.concat(F.lit("rows: "), F.col("n")))


def check_required(df: DataFrame, fields: list[str], name: str = "required_fields") -> DataFrame:
    """No required field is null; details list the number missing per field."""
    missing = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    total = reduce(lambda a, b: a + b, [F.col(f) for f in fields])
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{f}: "), F.col(f)) for f in fields])
    return _check(missing, name, total == 0, text)


def check_nested_items(nested: DataFrame, fields: tuple[str, ...] = ("query", "rank", "count")) -> DataFrame:
    """Every item of every nested list has its required fields."""
    complete = F.forall("trending_queries", lambda q: reduce(lambda a, b: a & b, [q[f].isNotNull() for f in fields]))
    bad = nested.agg(F.count_if(~F.coalesce(complete, F.lit(False))).alias("n"))
    return _check(bad, "item_fields", F.col("n") == 0, F.concat(F.lit("dates with errors: "), F.col("n")))


def rank_order(rows: DataFrame, order: str = "query_id") -> DataFrame:
    """Rows with a flag that the rank is not below the one before it on the same date."""
    before = F.lag("rank").over(Window.partitionBy("date").orderBy(order))
    return rows.withColumn("in_order", F.coalesce(before <= F.col("rank"), F.lit(True)))


def check_rank_order(rows: DataFrame, order: str = "query_id", name: str = "rank_order") -> DataFrame:
    bad = rank_order(rows, order).agg(F.count_if(~F.col("in_order")).alias("n"))
    return _check(bad, name, F.col("n") == 0, F.concat(F.lit("out of order: "), F.col("n")))


def check_result_freshness(rows: DataFrame, as_of, max_days: int = 7, name: str = "result_freshness") -> DataFrame:
    """The latest parseable date is at most ``max_days`` old; no date at all passes."""
    latest = rows.agg(F.max(F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd")).alias("d"))
    age = F.datediff(as_date(as_of), F.col("d"))
    details = F.coalesce(F.concat(F.lit("age days: "), age), F.lit("no data yet"))
    return _check(latest, name, F.coalesce(age <= max_days, F.lit(True)), details)


def check_event_freshness(
    events: DataFrame, as_of, ts: str = "timestamp", max_hours: int = 24, name: str = "event_freshness"
) -> DataFrame:
    """The newest event is at most ``max_hours`` old; an empty log passes."""
    newest = events.agg(F.max(F.col(ts).cast("timestamp")).alias("t"))
    seconds = F.unix_timestamp(as_timestamp(as_of)) - F.unix_timestamp("t")
    hours = F.floor(seconds / 3600)
    details = F.coalesce(F.concat(F.lit("age hours: "), hours), F.lit("no data yet"))
    return _check(newest, name, F.coalesce(seconds <= max_hours * 3600, F.lit(True)), details)


def check_schema(spark: SparkSession, df: DataFrame, declared: T.StructType, name: str = "schema") -> DataFrame:
    wrong = schema_differences(df.schema, declared)
    return spark.range(1).select(
        F.lit(name).alias("validation"),
        F.lit(not wrong).alias("success"),
        F.lit("differences: " + (", ".join(wrong) if wrong else "none")).alias("details"),
    )


def check_partitions(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = ("year", "month", "day", "hour"),
    name: str = "partitions",
) -> DataFrame:
    """The table below ``path`` is partitioned by ``columns`` and has no empty file; only listings are read."""
    files = list_files(spark, path)
    pattern = "^" + "/".join(f"{c}=[^/]+" for c in columns) + "/[^/]+$"
    seen = files.agg(
        F.count("*").alias("files"),
        F.count_if(~F.col("key").rlike(pattern)).alias("misplaced"),
        F.count_if(F.col("length") == 0).alias("empty"),
    )
    good = (F.col("files") > 0) & (F.col("misplaced") == 0) & (F.col("empty") == 0)
    details = F.concat(F.lit("misplaced: "), F.col("misplaced"), F.lit(", empty: "), F.col("empty"))
    return _check(seen, name, good, details)


def run_suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def check_summary(checks: DataFrame) -> DataFrame:
    """Passed, failed, total, and whether all passed."""
    totals = [
        F.count_if(F.col("success")).alias("passed"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count("*").alias("total"),
        F.coalesce(F.bool_and("success"), F.lit(True)).alias("all_passed"),
    ]
    if "duration" in checks.columns:
        totals.append(F.sum("duration").alias("total_duration"))
    return checks.agg(*totals)
