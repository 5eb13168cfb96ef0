"""Raw search log to one row per (query text, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.functions.columns import as_date, with_date_parts
from searchpulse.functions.joins import counted_side


def canonical_log(df: DataFrame) -> DataFrame:
    """One ``query_text`` column whichever of the two field names the producer used."""
    names = [c for c in ("query_text", "query") if c in df.columns]
    text = F.coalesce(*[F.col(c) for c in names], F.lit(""))
    return df.withColumn("query_text", text).drop("query")


def earliest_key(log: DataFrame) -> Column:
    """Event time, and the id where it is a number, as one decimal that sorts like the pair.

    A decimal has a fixed width, so its minimum lives in a hash aggregation, which
    the minimum of a struct with text does not.
    """
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("decimal(19,0)")
    numeric = "event_id" in log.columns and log.schema["event_id"].dataType.typeName() in ("long", "integer", "short")
    place = F.coalesce(F.col("event_id"), F.lit(0)).cast("decimal(19,0)") if numeric else F.lit(0).cast("decimal(19,0)")
    return (micros * F.lit("1" + "0" * 19).cast("decimal(20,0)")).cast("decimal(38,0)") + place


def consolidate(log: DataFrame, exact_users: bool = True) -> DataFrame:
    """Volume, distinct users, mean results, click rate and first source per query and day.

    Texts are grouped as they are, without trimming or case folding; a null text
    is a group of its own. ``source`` is that of the earliest event, so it does not
    depend on the order in which rows arrive.

    The log is first reduced by hash aggregation to one row per query, day, user
    and source, which spreads a query with a third of the log over its users. The
    distinct count and the first source run over what is left.
    """
    return daily_rows(reduce_log(log), exact_users)


DAY_KEYS = ["query_text", "date"]


def reduce_log(log: DataFrame, **extra: Column) -> DataFrame:
    """One row per query, day, user and source; such rows of several loads may stand side by side."""
    named = log.select(
        "query_text",
        F.to_date("timestamp").alias("date"),
        "user_id",
        "source",
        "results_count",
        "click_through",
        earliest_key(log).cast("decimal(38,0)").alias("first"),
        *[c for c in ("timestamp",) if extra],
    )
    return named.groupBy(*DAY_KEYS, "user_id", "source").agg(
        F.count("*").alias("n"),
        F.sum("results_count").alias("results"),
        F.count("results_count").alias("with_results"),
        F.count_if(F.coalesce("click_through", F.lit(False))).alias("clicks"),
        F.min("first").alias("first"),
        *[c.alias(name) for name, c in extra.items()],
    )


def daily_rows(reduced: DataFrame, exact_users: bool = True, **extra: Column) -> DataFrame:
    """Query-days from the rows of ``reduce_log``."""
    users = F.count_distinct("user_id") if exact_users else F.approx_count_distinct("user_id", 0.02)
    # The columns of a consolidated row.
    daily = reduced.groupBy(*DAY_KEYS).agg(
        F.sum("n").alias("query_count"),
        users.alias("unique_users"),
        F.try_divide(F.sum("results"), F.sum("with_results")).cast("double").alias("avg_results_count"),
        (F.sum("clicks") / F.sum("n")).alias("click_through_rate"),
        F.min_by("source", F.struct("first", "source")).alias("source"),
        *[c.alias(name) for name, c in extra.items()],
    )
    return with_date_parts(daily)


def recent(daily: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Rows strictly after ``as_of - days``: the last ``days`` dates up to and beyond as_of."""
    return daily.where(F.col("date") > F.date_sub(as_date(as_of), days))


def recent_high_volume(daily: DataFrame, as_of, days: int = 7, min_count: int = 5) -> DataFrame:
    return recent(daily, as_of, days).where(F.col("query_count") >= min_count)


def write_by_date(df: DataFrame, path: str, replace_all: bool = False) -> None:
    """Partitioned overwrite by ``date``.

    By default only the dates present in ``df`` are replaced. The rebalance hint
    lets adaptive execution merge small dates into few files and split a large
    date over many tasks, where ``repartition("date")`` would put one date in
    one task.
    """
    (
        df.hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if replace_all else "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def recompute_touched_days(spark: SparkSession, raw_path: str, new_rows: DataFrame, out_path: str) -> None:
    """Redo the days that newly landed rows belong to, and only those.

    The raw table is partitioned by ``date``. Its distinct dates are joined with
    the touched ones as partition values, so untouched days are not read, however
    many dates a load touches, and no date passes through the driver.
    """
    touched = new_rows.select(F.to_date("timestamp").alias("date")).distinct()
    # the comparison on the measured side lets Spark prune partitions while it runs
    wanted = counted_side(touched).where("date >= DATE '0001-01-01'")
    affected = spark.read.parquet(raw_path).join(wanted, "date", "left_semi")
    write_by_date(consolidate(affected.drop("date")), out_path)


def changed_dates(now: DataFrame, held: DataFrame) -> DataFrame:
    """Dates, null among them, whose fingerprints (``feed.date_prints``) are not those held from the last run.

    A corrected row changes its date's fingerprint also where the number of rows stays.
    """
    return now.exceptAll(held).unionByName(held.exceptAll(now)).select("date").distinct()


def rows_of_dates(log: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of ``log`` on the given dates; the span of the dates reaches the scan."""
    first, last, undated = dates.agg(F.min("date"), F.max("date"), F.count_if(F.col("date").isNull())).head()
    time, kind = F.col("timestamp"), log.schema["timestamp"].dataType
    within = F.lit(False)
    if first is not None:
        within = (time >= F.lit(first).cast(kind)) & (time < F.date_add(F.lit(last), 1).cast(kind))
    if undated:  # also a time that is no date
        within = within | F.to_date("timestamp").isNull()
    named = dates.select(F.col("date").alias("_date"))
    return log.where(within).join(counted_side(named), F.to_date("timestamp").eqNullSafe(F.col("_date")), "left_semi")
