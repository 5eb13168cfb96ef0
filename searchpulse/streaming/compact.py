"""Compaction of landed hours that are closed.

A landing stream writes a few files into an hour's folder with every batch. Once an
hour is over its folder gets no more rows (folders follow the delivery time), so it
is copied once into a table of larger files; readers take closed hours from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.functions.columns import as_timestamp
from searchpulse.functions.joins import counted_side
from searchpulse.sources.ingest import HOUR_PARTITIONS
from searchpulse.streaming.land import ACCEPTED

FOLDERS = ["outcome", *HOUR_PARTITIONS]


def folder_hour() -> Column:
    """Start of a folder's hour."""
    parts = [F.col(p).cast("int") for p in HOUR_PARTITIONS]
    return F.make_timestamp(*parts, F.lit(0), F.lit(0))


def stored_folders(spark: SparkSession, path: str) -> DataFrame:
    """The folders of an hour-partitioned table that hold files, from its listing alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], "outcome string, year int, month int, day int, hour int")
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listing.select(*FOLDERS).distinct()


def _rows_in(rows: DataFrame, folders: DataFrame, how: str) -> DataFrame:
    """Rows inside (or outside) the folders; inside, other folders are not read."""
    # the comparison lets Spark prune folders while it runs
    wanted = counted_side(folders.select(*FOLDERS)).where("year > 0")
    return rows.join(wanted, FOLDERS, how)


def compact_hours(spark: SparkSession, landed: str, compacted: str, before) -> int:
    """Copy the folders of hours that ended by ``before`` and are not copied yet; returns their number.

    A folder is written whole or, when the job is run again after a failure, written again.
    """
    over = folder_hour() + F.make_dt_interval(hours=F.lit(1)) <= as_timestamp(before)
    done = stored_folders(spark, compacted)
    todo = stored_folders(spark, landed).where(over).join(done, FOLDERS, "left_anti")
    number = todo.count()
    if number:
        rows = _rows_in(spark.read.parquet(landed), todo, "left_semi")
        writer = rows.hint("rebalance", *FOLDERS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*FOLDERS).parquet(compacted)
    return number


def compacted_events(spark: SparkSession, landed: str, compacted: str) -> DataFrame:
    """The raw search log: closed hours from the compacted table, the others as they landed."""
    done = stored_folders(spark, compacted)
    landing = spark.read.parquet(landed)
    rows = _rows_in(landing, done, "left_anti").select(*landing.columns)
    if done.limit(1).count():
        rows = rows.unionByName(spark.read.schema(landing.schema).parquet(compacted))
    return rows.where(F.col("outcome") == ACCEPTED).drop("outcome", "raw", "reject_reason")
