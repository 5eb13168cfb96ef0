"""Latency quantiles that merge: one KLL sketch per window, stored and rolled up into hours and days.

A sketch of ``ENTRIES`` keeps values whose rank among the data is off by at most
``RANK_ERROR`` (with 99 % confidence); merging sketches keeps that bound. A window of
fewer values than ``ENTRIES`` is kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchpulse.operators.metrics import metric_windows

ENTRIES = 800
#: Share of the rows by which the rank of an answer may be off.
RANK_ERROR = 0.01


def sketch_stats(value: str = "latency_ms", entries: int = ENTRIES) -> dict[str, Column]:
    """Aggregates for ``metric_windows`` and its stream twin: number of values, extremes and the sketch; nulls count for nothing."""
    v = F.col(value).cast("double")
    return {
        "n_values": F.count(v),
        "least": F.min(v),
        "most": F.max(v),
        "values": F.kll_sketch_agg_double(v, entries),
    }


def sketch_windows(df: DataFrame, seconds: int, groups: list[str], value: str = "latency_ms", ts: str = "ts") -> DataFrame:
    """One sketch per tumbling window and group."""
    return metric_windows(df, seconds, groups, sketch_stats(value), ts)


def roll_up(windows: DataFrame, seconds: int, groups: list[str], entries: int = ENTRIES) -> DataFrame:
    """Windows merged into longer ones of ``seconds``; these merge again."""
    start = (F.floor(F.col("window_start") / seconds) * seconds).cast("long").alias("window_start")
    return windows.groupBy(start, *groups).agg(
        F.sum("n_values").alias("n_values"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("values", entries).alias("values"),
    )


def quantile(share: float, sketch: str = "values") -> Column:
    """The value of that rank; null where the window has no values."""
    return F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))
