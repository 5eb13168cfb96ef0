"""Reads over the results table: by date, latest, paged, by category, by cluster."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchpulse.functions.columns import as_date

DEFAULT_LIMIT = 50
MAX_LIMIT = 100
ITEM_FIELDS = ["query", "rank", "count", "growth_rate", "category", "cluster_id"]


def parse_date(date: str | None) -> str:
    if not date:
        raise ValueError("a date is required")
    try:
        datetime.strptime(date, "%Y-%m-%d")
    except ValueError:
        raise ValueError(f"not a yyyy-MM-dd date: {date}") from None
    return date


def parse_limit(limit: str | int | None) -> int:
    try:
        n = DEFAULT_LIMIT if limit is None else int(limit)
    except (TypeError, ValueError):
        raise ValueError(f"limit is not an integer: {limit}") from None
    if not 1 <= n <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}: {n}")
    return n


def parse_token(token: str | None) -> dict | None:
    """Key after which a page starts, or None for the first page."""
    if not token:
        return None
    try:
        key = json.loads(base64.b64decode(token).decode("utf-8"))
        return {"date": key["date"], "query_id": key["query_id"]}
    except Exception as error:
        raise ValueError(f"unreadable page token: {error}") from None


def next_token(date: Column, query_id: Column) -> Column:
    """Opaque continuation token: base64 of the JSON key (without line breaks)."""
    key = F.to_json(F.struct(date.cast("string").alias("date"), query_id.alias("query_id")))
    return F.regexp_replace(F.base64(key.cast("binary")), r"[\r\n]", "")


def token_key(token: Column) -> Column:
    """The key inside a token as struct(date, query_id)."""
    return F.from_json(F.unbase64(token).cast("string"), "date string, query_id string")


def by_date(results: DataFrame, date) -> DataFrame:
    return results.where(F.col("date") == as_date(date))


def latest(results: DataFrame, as_of) -> DataFrame:
    """Rows of the newest date not after ``as_of``; empty if there is none."""
    newest = results.where(F.col("date") <= as_date(as_of)).agg(F.max("date").alias("d")).scalar()
    return results.where(F.col("date") == newest)


def trending_page(
    results: DataFrame, date: str | None, limit: str | int | None = None, token: str | None = None
) -> DataFrame:
    """One page of a date, ordered by rank, with the token of the next page.

    Page borders follow ``query_id``. One row more than asked for is fetched to
    know whether another page exists; ``next_token`` is null on the last page.
    """
    day, n, start = parse_date(date), parse_limit(limit), parse_token(token)
    # A date is a key as it is written: 2024-1-5 is accepted but is no stored date.
    written = datetime.strptime(day, "%Y-%m-%d").strftime("%Y-%m-%d") == day
    rows = by_date(results, day).where(F.lit(written))
    if start is not None and start["date"] != day:
        raise ValueError(f"the page token is for {start['date']}, not {day}")
    if start is not None:
        rows = rows.where(F.col("query_id") > start["query_id"])
    fetched = rows.orderBy("query_id").limit(n + 1)
    position = Window.orderBy("query_id")
    paged = fetched.withColumns({"_rn": F.row_number().over(position), "_after": F.lead("query_id").over(position)})
    ends_page = (F.col("_rn") == n) & F.col("_after").isNotNull()
    token_col = F.when(ends_page, next_token(F.col("date"), F.col("query_id")))
    return (
        paged.withColumn("next_token", F.max(token_col).over(Window.partitionBy()))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_after")
        .orderBy("rank", "query_id")
    )


def by_category(results: DataFrame, category: str) -> DataFrame:
    return results.where(F.col("category") == category).orderBy("rank", "date")


def by_cluster(results: DataFrame, cluster_id: int, descending: bool = False) -> DataFrame:
    order = F.desc("count") if descending else F.asc("count")
    return results.where(F.col("cluster_id") == cluster_id).orderBy(order, "date", "rank")


def format_items(rows: DataFrame, *kept: str) -> DataFrame:
    """Stored rows in response shape, as columns and as JSON; ``kept`` columns stay.

    The text may be stored under either name; optional fields that are null are
    left out of the JSON.
    """

    def stored(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None)

    shaped = rows.select(
        "date",
        F.coalesce(stored("query_text").cast("string"), stored("query").cast("string"), F.lit("")).alias("query"),
        F.coalesce(stored("rank").cast("int"), F.lit(0)).alias("rank"),
        F.coalesce(stored("count").cast("long"), F.lit(0)).alias("count"),
        stored("growth_rate").cast("double").alias("growth_rate"),
        stored("category").cast("string").alias("category"),
        stored("cluster_id").cast("int").alias("cluster_id"),
        *kept,
    )
    return shaped.withColumn("item", F.to_json(F.struct(*ITEM_FIELDS)))


def page_document(
    results: DataFrame, date: str | None, limit: str | int | None = None, token: str | None = None
) -> DataFrame:
    """A page as one JSON document: date, trending_queries by rank, next_token if there is one.

    A page holds at most ``MAX_LIMIT`` items; a date without rows gives an empty list.
    """
    items = format_items(trending_page(results, date, limit, token), "next_token")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "query", F.struct(*ITEM_FIELDS).alias("item"))))
    return items.agg(
        F.to_json(
            F.struct(
                F.lit(parse_date(date)).alias("date"),
                F.transform(ordered, lambda e: e["item"]).alias("trending_queries"),
                F.max("next_token").alias("next_token"),
            )
        ).alias("document")
    )


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Expose DataFrames to ad-hoc SQL under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def adhoc_sql(spark: SparkSession, sql: str, result_path: str | None = None) -> DataFrame:
    """Run SQL on the registered tables; keep the result when a location is given."""
    result = spark.sql(sql)
    if result_path is None:
        return result
    result.write.mode("overwrite").parquet(result_path)
    return spark.read.parquet(result_path)
