"""Visibility, retention and removal of test rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.functions.columns import as_date, as_timestamp
from searchpulse.functions.joins import counted_side
from searchpulse.session import ensure_checkpoint_dir

#: Folder name of a null partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

# Days a layer is kept, by environment.
RETENTION_DAYS = {
    "raw": {"default": 90, "prod": 2555},
    "processed": {"default": 60, "prod": 1825},
    "query_results": {"default": 7, "prod": 7},
}


def visible(rows: DataFrame, as_of) -> DataFrame:
    """Rows whose ``ttl`` (epoch seconds) lies after ``as_of``."""
    return rows.where(F.col("ttl") > F.unix_timestamp(as_timestamp(as_of)))


def retained(df: DataFrame, as_of, days: int) -> DataFrame:
    """Rows of the last ``days`` dates; on a date-partitioned table a partition filter."""
    return df.where(F.col("date") > F.date_sub(as_date(as_of), days))


def expired_dates(df: DataFrame, as_of, days: int) -> DataFrame:
    """Dates that fall out of retention, with the days past the limit."""
    limit = F.date_sub(as_date(as_of), days)
    return (
        df.where(F.col("date") <= limit)
        .select("date")
        .distinct()
        .withColumn("days_over", F.datediff(limit, F.col("date")))
    )


def _is_test(marker: str, col: str):
    return F.coalesce(F.col(col).contains(marker), F.lit(False))


def purge_preview(df: DataFrame, marker: str, col: str = "source") -> DataFrame:
    """How many rows a purge would remove and keep."""
    hit = _is_test(marker, col)
    return df.agg(F.count_if(hit).alias("to_delete"), F.count_if(~hit).alias("to_keep"))


def purge_prefix_preview(files: DataFrame, prefix: str) -> DataFrame:
    """Files (key, length) below a prefix: what removing it would free."""
    below = F.col("key").startswith(prefix)
    return files.agg(
        F.count_if(below).alias("to_delete"),
        F.coalesce(F.sum(F.when(below, F.col("length"))), F.lit(0).cast("long")).alias("bytes"),
    )


def purge(df: DataFrame, marker: str, col: str = "source") -> DataFrame:
    """Rows without the marker; write them to a new path, the input is not touched."""
    return df.where(~_is_test(marker, col))


def purge_stored(spark: SparkSession, path: str, partitions: list[str], marker: str, col: str = "source") -> DataFrame:
    """Remove the marked rows from a stored, partitioned table; returns the partitions that held some.

    The files with marked rows are found through their path; only the partitions
    that these files lie in are read again and written, all at once when every task is done.
    Partitions of which nothing is left are removed. A second run finds no marked row and
    writes nothing, so a run that failed is repeated.
    """
    ensure_checkpoint_dir(spark)
    table = spark.read.parquet(path)
    hit = _is_test(marker, col)
    marked = table.where(hit).select(F.col("_metadata.file_path").alias("file"), *partitions)
    touched = marked.groupBy(*partitions).agg(F.count("*").alias("removed"), F.count_distinct("file").alias("files")).checkpoint()
    if not touched.limit(1).count():
        return touched
    # the comparison lets Spark prune partitions while it runs
    wanted = counted_side(touched).where("removed > 0")
    same = reduce(lambda a, b: a & b, [table[p].eqNullSafe(wanted[p]) for p in partitions])
    kept = table.join(wanted, same, "left_semi").where(~hit)
    left = kept.select(*partitions).distinct().checkpoint()
    writer = kept.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)
    empty = touched.join(left, reduce(lambda a, b: a & b, [touched[p].eqNullSafe(left[p]) for p in partitions]), "left_anti")
    drop_folders(spark, path, empty, partitions)
    return touched


def drop_folders(spark: SparkSession, path: str, values: DataFrame, partitions: list[str]) -> int:
    """Delete the folders of the given partition values of a stored table; returns how many there were.

    One name for each folder passes through the driver, no row of the table.
    """
    store_path = spark._jvm.org.apache.hadoop.fs.Path
    store = store_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [F.concat(F.lit(f"{p}="), F.coalesce(F.col(p).cast("string"), F.lit(NO_VALUE))) for p in partitions]
    dropped = 0
    for row in values.select(F.concat_ws("/", *names).alias("folder")).distinct().toLocalIterator():
        dropped += store.delete(store_path(f"{path}/{row.folder}"), True)
    return dropped


def expired_partitions(spark: SparkSession, table: str, as_of, days: int) -> DataFrame:
    """Catalogued dates of ``table`` that are out of retention, with the days past the limit; reads no data."""
    listed = spark.sql(f"SHOW PARTITIONS {table}")
    dates = listed.select(F.to_date(F.regexp_extract("partition", "(?:^|/)date=([^/]+)", 1), "yyyy-MM-dd").alias("date"))
    return expired_dates(dates, as_of, days)


def expire_partitions(spark: SparkSession, table: str, path: str, as_of, days: int, dry_run: bool = True) -> DataFrame:
    """Take expired dates out of a catalogued external table partitioned by date; returns them.

    A dry run only lists them. The catalogue forgets the partitions first, so a
    query planned from then on does not see them, while one that is running still finds its files.
    They are deleted by ``sweep_expired``, which the next run calls.
    """
    ensure_checkpoint_dir(spark)
    expired = expired_partitions(spark, table, as_of, days).checkpoint()
    if dry_run:
        return expired
    # before the catalogue changes: the sweep deletes what is noted here and no longer catalogued
    expired.select("date", as_date(as_of).alias("dropped_on")).write.mode("append").parquet(f"{path}/_expired")
    for row in expired.toLocalIterator():
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (date = DATE '{row.date}')")
    return expired


def sweep_expired(spark: SparkSession, table: str, path: str, as_of, grace_days: int = 1) -> int:
    """Delete the files of dates dropped at least ``grace_days`` ago; returns the number of folders.

    A date that has been catalogued again since then keeps its files.
    """
    noted = f"{path}/_expired"
    place = spark._jvm.org.apache.hadoop.fs.Path(noted)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return 0
    listed = spark.sql(f"SHOW PARTITIONS {table}")
    there = listed.select(F.to_date(F.regexp_extract("partition", "(?:^|/)date=([^/]+)", 1), "yyyy-MM-dd").alias("date"))
    old = spark.read.parquet(noted).groupBy("date").agg(F.max("dropped_on").alias("dropped_on"))
    due = old.where(F.col("dropped_on") <= F.date_sub(as_date(as_of), grace_days)).join(there, "date", "left_anti")
    return drop_folders(spark, path, due, ["date"])
