"""Windowed metrics and consecutive-period alarms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchpulse.functions.joins import join_null_safe
from searchpulse.operators.percentiles import order_statistics


@dataclass(frozen=True)
class AlarmRule:
    """Alarm when ``metric`` is at or above ``threshold`` in ``periods`` windows in a row."""

    metric: str
    threshold: float
    periods: int


# The default alarms, all on five-minute windows; a window without
# data does not breach.
ALARM_PERIOD_SECONDS = 300
DEFAULT_ALARMS = [
    AlarmRule("runs_failed", 1, 1),
    AlarmRule("runs_timed_out", 1, 1),
    AlarmRule("requests_5xx", 10, 2),
    AlarmRule("requests_4xx", 50, 2),
    AlarmRule("latency_p99_ms", 3000, 3),
    AlarmRule("function_errors", 5, 2),
    AlarmRule("function_throttles", 10, 2),
    AlarmRule("table_user_errors", 10, 2),
    AlarmRule("table_system_errors", 5, 2),
]


def window_start_seconds(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window as epoch seconds."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.floor(micros / (seconds * 1_000_000)).cast("long") * seconds


def metric_windows(
    df: DataFrame, seconds: int, groups: list[str], stats: dict[str, Column], ts: str = "ts"
) -> DataFrame:
    """Aggregates per tumbling window and group; windows are named by their start."""
    return df.groupBy(window_start_seconds(F.col(ts), seconds).alias("window_start"), *groups).agg(
        *[c.alias(name) for name, c in stats.items()]
    )


def request_stats() -> dict[str, Column]:
    """Traffic, error and latency series of a request log, for batches and streams.

    Streams cannot sort a window: their p99 comes from a bounded summary and says
    so in its name. ``request_windows`` has the exact one.
    """
    status = F.col("status")
    return {
        "requests": F.count("*"),
        "bytes": F.sum("bytes"),
        "errors_4xx": F.count_if((status >= 400) & (status < 500)),
        "errors_5xx": F.count_if(status >= 500),
        "latency_avg_ms": F.avg("latency_ms"),
        "latency_max_ms": F.max("latency_ms"),
        "latency_p99_approx_ms": F.percentile_approx("latency_ms", 0.99, 10_000),
    }


def discrete_rank(percent: int):
    """Zero-based position of the discrete percentile: the smallest value with at least that share at or below it."""
    return lambda n: F.greatest(F.ceil(n * percent / 100).cast("long") - 1, F.lit(0))


def request_windows(df: DataFrame, seconds: int, groups: list[str], ts: str = "ts") -> DataFrame:
    """Windows of ``request_stats`` with the exact 99th percentile of the latency instead of the approximate one."""
    stats = {name: c for name, c in request_stats().items() if name != "latency_p99_approx_ms"}
    windows = metric_windows(df, seconds, groups, stats, ts)
    keys = ["window_start", *groups]
    placed = df.withColumn("window_start", window_start_seconds(F.col(ts), seconds))
    exact = order_statistics(placed, keys, "latency_ms", {"p99": discrete_rank(99)})
    exact = exact.select(*keys, F.col("value").alias("latency_p99_ms"))
    return join_null_safe(windows, exact, keys, "left")


def windows_for_rules(df: DataFrame, seconds: int, groups: list[str], rules: list[AlarmRule], stats: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Windows with only the series that the rules name, out of ``stats`` and the exact ``latency_p99_ms``."""
    named = {r.metric for r in rules}
    windows = metric_windows(df, seconds, groups, {name: c for name, c in stats.items() if name in named} or {"n": F.count("*")}, ts)
    if "latency_p99_ms" not in named:
        return windows
    placed = df.withColumn("window_start", window_start_seconds(F.col(ts), seconds))
    keys = ["window_start", *groups]
    exact = order_statistics(placed, keys, "latency_ms", {"p99": discrete_rank(99)})
    return join_null_safe(windows, exact.select(*keys, F.col("value").alias("latency_p99_ms")), keys, "left")


def run_stats() -> dict[str, Column]:
    """Outcome and duration series of runs: columns status and duration_ms."""
    outcomes = ["succeeded", "failed", "timed_out"]
    return {
        "runs_started": F.count("*"),
        **{f"runs_{o}": F.count_if(F.col("status") == o) for o in outcomes},
        "duration_avg_ms": F.avg("duration_ms"),
        "duration_max_ms": F.max("duration_ms"),
    }


def function_stats() -> dict[str, Column]:
    """Invocations, errors, throttles and mean duration of functions."""
    return {
        "function_invocations": F.count("*"),
        "function_errors": F.count_if(F.col("status") == "error"),
        "function_throttles": F.count_if(F.col("status") == "throttled"),
        "duration_avg_ms": F.avg("duration_ms"),
    }


def table_stats() -> dict[str, Column]:
    """Consumed capacity and errors of a results table, and its completed tasks."""
    return {
        "read_units": F.sum("read_units"),
        "write_units": F.sum("write_units"),
        "table_user_errors": F.count_if(F.col("status") == "user_error"),
        "table_system_errors": F.count_if(F.col("status") == "system_error"),
        "tasks_completed": F.count_if(F.col("status") == "completed"),
    }


def lag_windows(df: DataFrame, seconds: int, groups: list[str]) -> DataFrame:
    """Largest delivery lag per arrival window, in milliseconds."""
    arrived, happened = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("arrival_time", "event_time"))
    lag = F.floor((arrived - happened) / 1000).cast("long")
    return metric_windows(df, seconds, groups, {"max_lag_ms": F.max(lag)}, ts="arrival_time")


def breaches(windows: DataFrame, rules: list[AlarmRule], groups: list[str]) -> DataFrame:
    """One row per window, group and rule that is at or above its threshold.

    The rules are a literal array, so the metric columns turn into rows without a
    join: columns window_start, groups, metric, value, periods.
    """
    candidates = [
        F.struct(
            F.lit(r.metric).alias("metric"),
            F.col(r.metric).cast("double").alias("value"),
            F.lit(float(r.threshold)).alias("threshold"),
            F.lit(r.periods).alias("periods"),
        )
        for r in rules
    ]
    return (
        windows.select("window_start", *groups, F.inline(F.array(*candidates)))
        .where(F.col("value") >= F.col("threshold"))
        .drop("threshold")
    )


def alarm_states(windows: DataFrame, rules: list[AlarmRule], groups: list[str], seconds: int) -> DataFrame:
    """ALARM / OK for every window that has data.

    A range frame of M - 1 periods counts the breaching windows among the last
    M; an absent window adds nothing, which is how missing data should count.
    """
    out = []
    for rule in rules:
        ordered = Window.partitionBy(*groups).orderBy("window_start")
        frame = ordered.rangeBetween(-(rule.periods - 1) * seconds, 0)
        breach = F.when(F.col(rule.metric) >= rule.threshold, 1).otherwise(0)
        state = F.when(F.sum(breach).over(frame) == rule.periods, "ALARM").otherwise("OK")
        out.append((f"{rule.metric}_state", state))
    return windows.withColumns(dict(out))


def alarm_transitions(windows: DataFrame, rules: list[AlarmRule], groups: list[str], seconds: int) -> DataFrame:
    """Changes of state: rows (groups, metric, state, changed_at), the time being the window's start.

    Breaching windows that follow each other without a gap form a run. A run of
    at least M windows raises the alarm at its M-th window and clears it at the
    first window after its end, whether or not that window has data.
    """
    by_metric = Window.partitionBy(*groups, "metric").orderBy("window_start")
    runs = (
        breaches(windows, rules, groups)
        .withColumn("run", F.col("window_start") - F.row_number().over(by_metric) * seconds)
        .groupBy(*groups, "metric", "periods", "run")
        .agg(F.min("window_start").alias("first"), F.count("*").alias("length"))
        .where(F.col("length") >= F.col("periods"))
    )
    raised = F.col("first") + (F.col("periods") - 1) * seconds
    cleared = F.col("first") + F.col("length") * seconds
    changes = F.array(
        F.struct(F.lit("ALARM").alias("state"), raised.alias("changed_at")),
        F.struct(F.lit("OK").alias("state"), cleared.alias("changed_at")),
    )
    return runs.select(*groups, "metric", F.inline(changes))
