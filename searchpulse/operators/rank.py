"""Ranking of a day's queries, and the stored results table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchpulse.functions.columns import as_date, as_timestamp
from searchpulse.operators.consolidate import write_by_date
from searchpulse.schemas import RESULT_ROW, TREND_ITEM_FIELDS


def top_per_cluster(
    df: DataFrame,
    n: int = 5,
    keys: tuple[str, ...] = ("cluster_id",),
    tie: tuple[str, ...] = ("query_text", "date"),
) -> DataFrame:
    """The ``n`` rows with the highest volume in every cluster.

    The filter on row_number becomes a group limit below the shuffle, so each
    task sends at most ``n`` rows per cluster.
    """
    tie = tuple(t for t in tie if t in df.columns and t not in keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("query_count"), *tie)
    return df.withColumn("cluster_rank", F.row_number().over(order)).where(F.col("cluster_rank") <= n)


def trend_items(ranked: DataFrame) -> DataFrame:
    """Rows in the published shape; missing fields take their defaults.

    A growth that is null stays null (there was no day before); only a table
    without growth gets 0.0.
    """

    def col(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in ranked.columns else F.lit(default)

    return ranked.select(
        "date",
        col("query_text", "").alias("query"),
        F.col("rank").cast("int").alias("rank"),
        col("query_count", 0).cast("long").alias("count"),
        col("unique_users", 0).cast("long").alias("unique_users"),
        col("category", "other").alias("category"),
        col("cluster_id", 0).cast("int").alias("cluster_id"),
        F.round(col("click_through_rate", 0.0).cast("double"), 3).alias("click_through_rate"),
        (F.col("growth_rate") if "growth_rate" in ranked.columns else F.lit(0.0)).cast("double").alias("growth_rate"),
    )


def rank_trends(df: DataFrame, top_n: int = 50, tie: tuple[str, ...] = ("query_text",)) -> DataFrame:
    """Ranks 1..top_n by volume for every date; equal volumes get different ranks by text."""
    order = Window.partitionBy("date").orderBy(F.desc("query_count"), *tie)
    ranked = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return trend_items(ranked)


def rank_overall(df: DataFrame, top_n: int = 50, tie: tuple[str, ...] = ("query_text", "date")) -> DataFrame:
    """One ranking over all rows; the window runs over the at most top_n survivors."""
    top = df.orderBy(F.desc("query_count"), *tie).limit(top_n)
    order = Window.orderBy(F.desc("query_count"), *tie)
    return trend_items(top.withColumn("rank", F.row_number().over(order)))


def query_id(rank: Column, query: Column) -> Column:
    """Sort key of a result row: zero-padded rank, then a digest of the text."""
    return F.concat(F.lpad(rank.cast("string"), 6, "0"), F.lit("#"), F.substring(F.sha2(query, 256), 1, 12))


def result_rows(items: DataFrame, processed_at, ttl_days: int = 30) -> DataFrame:
    """Trend items as keyed rows with visibility end and processing time."""
    at = as_timestamp(processed_at)
    return items.select(
        "date",
        query_id(F.col("rank"), F.col("query")).alias("query_id"),
        *TREND_ITEM_FIELDS,
        (F.unix_timestamp(at) + ttl_days * 86400).alias("ttl"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at"),
    )


def store_results(rows: DataFrame, path: str) -> None:
    """Replace the stored rows of the dates in ``rows``; other dates stay."""
    write_by_date(rows, path)


def clustered_for_date(spark: SparkSession, path: str, date, schema: T.StructType | None = None) -> DataFrame:
    """Clustered rows of one date: a partition-pruned read, empty if the date is absent."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).where(F.col("date") == as_date(date))


def nest_results(rows: DataFrame) -> DataFrame:
    """One row per date with its items as an ordered array (a day holds at most top_n)."""
    item = F.struct(*TREND_ITEM_FIELDS)
    return rows.groupBy("date").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("query_id"), item.alias("item")))),
            lambda e: e["item"],
        ).alias("trending_queries"),
        F.max("ttl").alias("ttl"),
        F.max("processed_at").alias("processed_at"),
        F.count("*").cast("int").alias("query_count"),
    )


def json_results(nested: DataFrame) -> DataFrame:
    """The nested view with its items as one JSON text per date."""
    return nested.withColumn("trending_queries", F.to_json("trending_queries"))


def parse_json_results(texts: DataFrame) -> DataFrame:
    """Back from JSON text to the nested view."""
    items = T.ArrayType(T.StructType([RESULT_ROW[name] for name in TREND_ITEM_FIELDS]))
    return texts.withColumn("trending_queries", F.from_json("trending_queries", items))


def explode_results(nested: DataFrame) -> DataFrame:
    """Back from one row per date to one row per query."""
    flat = nested.select("date", F.inline("trending_queries"), "ttl", "processed_at")
    key = query_id(F.col("rank"), F.col("query")).alias("query_id")
    return flat.select("date", key, *TREND_ITEM_FIELDS, "ttl", "processed_at")
