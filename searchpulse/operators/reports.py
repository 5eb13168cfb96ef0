"""Latency, status, cost and compression reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchpulse.functions.columns import as_date, percent_text, safe_ratio
from searchpulse.functions.joins import join_null_safe
from searchpulse.operators.percentiles import floor_rank, lower_middle, order_statistics, spread, upper_middle


def latency_report(requests: DataFrame, groups: list[str], target_rps: float | None = None) -> DataFrame:
    """Request counts, rates and latency statistics per group.

    Latencies are those of successful requests (status below 400); the rate is
    all requests over the time between the first and the last one.
    """
    ok = F.col("status") < 400
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    totals = requests.groupBy(*groups).agg(
        F.count("*").alias("total_requests"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("errors"),
        ((F.max(micros) - F.min(micros)) / 1_000_000).alias("duration_seconds"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("avg_latency_ms"),
        F.min(F.when(ok, F.col("latency_ms"))).alias("min_latency_ms"),
        F.max(F.when(ok, F.col("latency_ms"))).alias("max_latency_ms"),
    )
    wanted = {"lower": lower_middle, "upper": upper_middle, "p95": floor_rank(95), "p99": floor_rank(99)}
    order = spread(order_statistics(requests.where(ok), groups, "latency_ms", wanted), groups, list(wanted))
    duration = F.col("duration_seconds")
    joined = join_null_safe(join_null_safe(totals, order, groups, "left"), status_map(requests, groups), groups, "left")
    report = joined.select(
        *groups,
        "total_requests",
        "successful",
        "errors",
        duration,
        safe_ratio(F.col("total_requests"), duration).alias("actual_rps"),
        (F.col("successful") / F.col("total_requests")).alias("success_rate"),
        "status_codes",
        *[F.coalesce(c, F.lit(0.0)).alias(name) for c, name in _latency_columns()],
    )
    return report if target_rps is None else report.withColumn("target_rps", F.lit(float(target_rps)))


def _latency_columns() -> list[tuple[Column, str]]:
    return [
        (F.col("avg_latency_ms"), "avg_latency_ms"),
        ((F.col("lower") + F.col("upper")) / 2, "median_latency_ms"),
        (F.col("p95"), "p95_latency_ms"),
        (F.col("p99"), "p99_latency_ms"),
        (F.col("min_latency_ms"), "min_latency_ms"),
        (F.col("max_latency_ms"), "max_latency_ms"),
    ]


def status_distribution(requests: DataFrame, groups: list[str]) -> DataFrame:
    return requests.groupBy(*groups, "status").agg(F.count("*").alias("requests"))


def status_map(requests: DataFrame, groups: list[str]) -> DataFrame:
    """The same counts as one map per group; a group has few distinct codes."""
    return (
        status_distribution(requests, groups)
        .groupBy(*groups)
        .agg(F.map_from_entries(F.collect_list(F.struct("status", "requests"))).alias("status_codes"))
    )


def cost_by_service(costs: DataFrame, end, days: int = 7) -> DataFrame:
    """Cost per service over [end - days, end) with the grand total as the ``total`` row, largest first."""
    last = as_date(end)
    in_range = (F.col("date") >= F.date_sub(last, days)) & (F.col("date") < last)
    rolled = costs.where(in_range).rollup("service").agg(
        F.round(F.sum("amount"), 2).alias("cost"), F.grouping("service").alias("_total")
    )
    return rolled.select(
        F.when(F.col("_total") == 1, F.lit("total")).otherwise(F.col("service")).alias("service"), "cost"
    ).orderBy(F.desc("cost"), "service")


def compression_summary(files: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Totals over per-file results (success, original_size, compressed_size).

    Failed files count as failed and add nothing to the sizes.
    """
    ok = F.col("success")
    original = F.coalesce(F.sum(F.when(ok, F.col("original_size"))), F.lit(0))
    compressed = F.coalesce(F.sum(F.when(ok, F.col("compressed_size"))), F.lit(0))
    ratio = safe_ratio(F.col("total_original_size") - F.col("total_compressed_size"), F.col("total_original_size"))
    return (
        files.groupBy(*(groups or []))
        .agg(
            F.count_if(ok).alias("files_processed"),
            F.count_if(~ok).alias("files_failed"),
            original.alias("total_original_size"),
            compressed.alias("total_compressed_size"),
        )
        .withColumn("compression_ratio", ratio)
        .withColumn("compression_percent", percent_text(F.col("compression_ratio")))
    )


def compression_metrics(summary: DataFrame, at: Column, namespace: str = "searchpulse/compression") -> DataFrame:
    """The summary as one metric point per row: name, value, unit, time."""
    points = [
        ("FilesProcessed", F.col("files_processed"), "Count"),
        ("FilesFailed", F.col("files_failed"), "Count"),
        ("OriginalSize", F.col("total_original_size"), "Bytes"),
        ("CompressedSize", F.col("total_compressed_size"), "Bytes"),
        ("CompressionRatio", F.col("compression_ratio") * 100, "Percent"),
    ]
    structs = [
        F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))
        for name, value, unit in points
    ]
    return summary.select(F.lit(namespace).alias("namespace"), F.inline(F.array(*structs)), at.alias("ts"))
