"""Adapters that read the bundled star-schema tables as search-log inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_search_log(events: DataFrame, texts: int | None = None) -> DataFrame:
    """Events as a search log; ``texts`` folds the query texts to that many."""
    k = F.get_json_object("props", "$.k").cast("long")
    if texts is not None:
        k = k % texts
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"),
        F.concat(F.lit("query "), k).alias("query_text"),
        F.col("value").alias("results_count"),
        F.col("event_type").isin("click", "purchase").alias("click_through"),
        F.col("event_type").alias("source"),
    )


def search_log(spark: SparkSession, sf_dir: str, texts: int | None = None) -> DataFrame:
    return as_search_log(table(spark, sf_dir, "events"), texts)


def query_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as query-day rows: whole text, length as volume."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("query_text"),
        F.col("n_chars").alias("query_count"),
        "lang",
        "source",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("service"),
        F.col("value").alias("latency_ms"),
        F.when(failed, 500).otherwise(200).alias("status"),
        F.length("props").alias("bytes"),
    )


def arrival_delay(event_id: Column) -> Column:
    return F.make_dt_interval(secs=(event_id % 600).cast("decimal(18,6)"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a delivery time up to ten minutes after the event time."""
    delay = arrival_delay(F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("event_time"),
        (F.col("ts") + delay).alias("arrival_time"),
        F.col("event_type").alias("service"),
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("service"),
        F.col("o_totalprice").alias("amount"),
    )


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object keys of the shapes the file predicates distinguish, one per event."""
    n = F.col("event_id")
    folders = F.array(*map(F.lit, ["raw-data/", "logs/", "images/", "compressed/"]))
    suffixes = F.array(*map(F.lit, [".json", ".LOG", ".png", ".gz", ".csv"]))
    folder = F.element_at(folders, (n % 4 + 1).cast("int"))
    suffix = F.element_at(suffixes, (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        n.alias("event_id"),
        F.concat(
            folder,
            F.date_format("ts", "'year='yyyy'/month='MM'/day='dd'/'"),
            F.lit("part-"),
            n,
            suffix,
        ).alias("key"),
        F.length("props").cast("long").alias("size"),
    )
