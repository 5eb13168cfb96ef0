"""Exact order statistics of groups that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchpulse.functions.joins import counted_side, join_null_safe

BUCKETS = 4096


def floor_rank(percent: int) -> Callable[[Column], Column]:
    """Zero-based position min(int(n * percent / 100), n - 1) in ascending order."""
    return lambda n: F.least(F.floor(n * percent / 100).cast("long"), n - 1)


def lower_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2).cast("long")


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2).cast("long")


def _coarse_bucket(v: Column) -> Column:
    """Monotone bucket number, the same for every input: 64 buckets for each power of two.

    Following the exponent of the number, buckets are as fine around a
    microsecond as around a year.
    """
    size = F.abs(v)
    place = F.floor(F.log2(F.greatest(size, F.lit(4.9e-324))) * 64) + 1_076 * 64
    number = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(200_000)).otherwise(place)
    return F.when(F.isnan(v), F.lit(200_001)).otherwise((F.signum(v) * number).cast("int"))


def _fine_bucket(v: Column, lo: Column, hi: Column) -> Column:
    """Monotone bucket number of ``v`` in [lo, hi], linear."""
    share = (v - lo) / (hi - lo)
    return F.when(hi > lo, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).otherwise(F.lit(0))


def order_statistics(
    df: DataFrame,
    groups: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Per group, the values at the given positions: columns groups, statistic, value.

    A histogram taken straight from the scan locates the bucket of every wanted
    position, and only its buckets are shuffled. A second scan keeps the rows of
    the located buckets and divides each into 4096 parts; a third keeps the rows of
    the parts that hold a position and counts their equal values. No step shuffles,
    sorts or collects a whole group, and the windows run over buckets, not rows.
    """
    v, c = F.col("_v"), F.col("_c")
    values = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    coarse = values.withColumn("_b", _coarse_bucket(v))
    extent = [F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    def locate(histogram: DataFrame, keys: list[str], bucket: str) -> DataFrame:
        """Keep the bucket that holds position ``_k``, re-basing ``_k`` to it."""
        running = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum("_c").over(running)
        return (
            histogram.withColumn("_before", upto - c)
            .where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + c))
            .withColumn("_k", F.col("_k") - F.col("_before"))
            .drop("_before", "_c")
        )

    n = F.sum("_c").over(Window.partitionBy(*groups))
    positions = [F.struct(F.lit(s).alias("s"), rank(F.col("_n")).alias("k")) for s, rank in ranks.items()]
    first = (
        coarse.groupBy(*groups, "_b")
        .agg(*extent)
        .withColumn("_n", n)
        .withColumn("_w", F.explode(F.array(*positions)))
        .select("*", F.col("_w.s").alias("statistic"), F.col("_w.k").alias("_k"))
        .drop("_w", "_n")
    )
    by_stat = [*groups, "statistic"]
    hit = counted_side(locate(first, by_stat, "_b"))

    fine = join_null_safe(coarse, hit, [*groups, "_b"])
    fine = fine.withColumn("_f", _fine_bucket(v, F.col("_lo"), F.col("_hi")))
    second = fine.groupBy(*by_stat, "_b", "_k", "_f", F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).agg(*extent)
    hit2 = counted_side(locate(second, by_stat, "_f"))

    last = join_null_safe(coarse, hit2.drop("_lo", "_hi"), [*groups, "_b"])
    last = last.where(_fine_bucket(v, F.col("_from"), F.col("_to")) == F.col("_f"))
    equal = last.groupBy(*by_stat, "_k", "_v").agg(F.count("*").alias("_c"))
    return locate(equal, by_stat, "_v").select(*by_stat, v.alias("value"))


def percentile_floor(df: DataFrame, groups: list[str], value: str, percents: list[int]) -> DataFrame:
    """Floor-index percentiles as columns p50, p95, ..."""
    names = [f"p{p}" for p in percents]
    stats = order_statistics(df, groups, value, {name: floor_rank(p) for name, p in zip(names, percents)})
    return spread(stats, groups, names)


def medians(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """True median (mean of the middle values) and upper median."""
    stats = order_statistics(df, groups, value, {"lower": lower_middle, "upper": upper_middle})
    wide = spread(stats, groups, ["lower", "upper"])
    middle = (F.col("lower") + F.col("upper")) / 2
    return wide.select(*groups, middle.alias("median"), F.col("upper").alias("upper_median"))


def spread(stats: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """One column per statistic."""
    return stats.groupBy(*groups).agg(
        *[F.max(F.when(F.col("statistic") == name, F.col("value"))).alias(name) for name in names]
    )
