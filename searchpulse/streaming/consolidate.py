"""Incremental query-day consolidation with an exact distinct count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_consolidate(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Query-day aggregates of an event stream, emitted once a day is complete (append mode).

    Two chained aggregations: per (day, query, user), then per (day, query).
    The second one counts users that are already distinct, so the result is
    exact, and a hot query's state is spread over its users. ``source`` is the
    source of the earliest event.
    """
    order = F.struct(*[c for c in ("timestamp", "event_id", "source") if c in log.columns])
    per_user = (
        log.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 day").alias("day"), "query_text", "user_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("results_count").alias("results"),
            F.count("results_count").alias("with_results"),
            F.count_if(F.coalesce("click_through", F.lit(False))).alias("clicks"),
            F.min(order).alias("first_event"),
        )
    )
    per_query = per_user.groupBy(F.window("day", "1 day").alias("window"), "query_text").agg(
        F.sum("n").alias("query_count"),
        F.count("user_id").alias("unique_users"),
        F.try_divide(F.sum("results"), F.sum("with_results")).alias("avg_results_count"),
        (F.sum("clicks") / F.sum("n")).alias("click_through_rate"),
        F.min("first_event").alias("first_event"),
    )
    return per_query.select(
        "query_text",
        F.to_date("window.start").alias("date"),
        "query_count",
        "unique_users",
        "avg_results_count",
        "click_through_rate",
        F.col("first_event.source").alias("source"),
    )
