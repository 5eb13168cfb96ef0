"""Alarm transitions on a stream of requests or metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchpulse.operators.metrics import AlarmRule, breaches


def stream_metric_windows(
    df: DataFrame, ts: str, seconds: int, groups: list[str], stats: dict[str, Column], watermark: str
) -> DataFrame:
    """Tumbling-window aggregates with the window itself kept as ``window``."""
    return (
        df.withWatermark(ts, watermark)
        .groupBy(F.window(ts, f"{seconds} seconds").alias("window"), *groups)
        .agg(*[c.alias(name) for name, c in stats.items()])
        .withColumn("window_start", F.unix_timestamp("window.start"))
    )


def alarm_stream(windows: DataFrame, rules: list[AlarmRule], groups: list[str], seconds: int) -> DataFrame:
    """State changes of every rule: (groups, metric, state, changed_at), append mode.

    A second, sliding aggregation looks at the last M + 1 windows of a metric.
    It keeps the start times of the breaching ones only (at most M + 1), so a
    window without data counts as not breaching, and silence clears an alarm as
    soon as the watermark has passed it.
    """
    longest = max(r.periods for r in rules) + 1
    hits = breaches(windows, rules, ["window", *groups])
    span = F.window("window", f"{longest * seconds} seconds", f"{seconds} seconds").alias("span")
    spans = hits.groupBy(span, *groups, "metric", "periods").agg(F.collect_set("window_start").alias("starts"))
    last = F.unix_timestamp("span.end") - seconds

    def breached(offset: Column) -> Column:
        return F.array_contains("starts", last - offset * seconds)

    now = F.forall(F.sequence(F.lit(0), F.col("periods") - 1), breached)
    before = F.forall(F.sequence(F.lit(1), F.col("periods")), breached)
    state = F.when(now & ~before, "ALARM").when(~now & before, "OK")
    changes = spans.select(*groups, "metric", state.alias("state"), last.alias("changed_at"))
    return changes.where(F.col("state").isNotNull())
