"""Declared schemas: nothing in the batch or streaming path infers types."""

from __future__ import annotations

from pyspark.sql import types as T

# One search event after parsing.
SEARCH_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("results_count", T.IntegerType()),
        T.StructField("click_through", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)

# The same event on the wire. Producers name the text `query` or `query_text`
# and send the time as text, so both stay strings until they are checked.
SEARCH_EVENT_WIRE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("results_count", T.IntegerType()),
        T.StructField("click_through", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)

CONSOLIDATED = T.StructType(
    [
        T.StructField("query_text", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("query_count", T.LongType()),
        T.StructField("unique_users", T.LongType()),
        T.StructField("avg_results_count", T.DoubleType()),
        T.StructField("click_through_rate", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
    ]
)

CLUSTERED = T.StructType(
    [
        T.StructField("query_text", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("query_count", T.LongType()),
        T.StructField("unique_users", T.LongType()),
        T.StructField("avg_results_count", T.DoubleType()),
        T.StructField("click_through_rate", T.DoubleType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("processing_timestamp", T.StringType()),
        T.StructField("cluster_count", T.IntegerType()),
    ]
)

# One ranked row of a day; the results table is this plus date, query_id and
# the bookkeeping columns.
TREND_ITEM_FIELDS = [
    "query",
    "rank",
    "count",
    "unique_users",
    "category",
    "cluster_id",
    "click_through_rate",
    "growth_rate",
]

RESULT_ROW = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("count", T.LongType()),
        T.StructField("unique_users", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("click_through_rate", T.DoubleType()),
        T.StructField("growth_rate", T.DoubleType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("processed_at", T.StringType()),
    ]
)


def schema_differences(actual: T.StructType, declared: T.StructType) -> list[str]:
    """Names of declared columns that are missing or carry another type."""
    found = {f.name: f.dataType for f in actual.fields}
    return [f.name for f in declared.fields if found.get(f.name) != f.dataType]
