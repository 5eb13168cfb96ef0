"""Index copies of the results table: all dates of one category or cluster without reading the others.

An index is a second copy of the results, cut by a bucket of the indexed column and by
month, and sorted by that column inside a file. A lookup reads one bucket of every month, and
within its files the row groups whose statistics or Bloom filter allow the value. It is
refreshed together with the day's put: the months of the dates that were written are
derived again from the results table, so a row that moved to another value leaves no trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchpulse.functions.joins import counted_side

BUCKETS = 16
#: Rows of a row group, about: small ones, so that a value's rows stand in few of them.
GROUP_BYTES = 1 << 20


def bucket_of(value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(buckets)).cast("int")


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def refresh_index(results: DataFrame, index_path: str, column: str, dates: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Derive the index of ``column`` again for the months of ``dates`` (all months by default).

    ``results`` is the stored table, partitioned by date. Every bucket of a month is
    written, one without rows with an empty marker row, so nothing old remains in it.
    """
    month = month_of(F.col("date"))
    if dates is not None:
        wanted = dates.select(F.explode(F.sequence(F.trunc("date", "month"), F.last_day("date"))).alias("date")).distinct()
        results = results.join(counted_side(wanted).where("date > DATE '0001-01-01'"), "date", "left_semi")
        months = dates.select(month.alias("_month")).distinct()
    else:
        months = results.select(month.alias("_month")).distinct()
    placed = results.withColumns({"_bucket": bucket_of(F.col(column), buckets), "_month": month})
    marks = months.select("_month", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"))
    rows = placed.unionByName(marks, allowMissingColumns=True)
    (
        rows.repartition("_bucket", "_month")
        .sortWithinPartitions("_bucket", "_month", column, "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", GROUP_BYTES)
        .option(f"parquet.bloom.filter.enabled#{column}", "true")
        .partitionBy("_bucket", "_month")
        .parquet(index_path)
    )


def lookup(spark: SparkSession, index_path: str, schema: T.StructType, column: str, value, buckets: int = BUCKETS) -> DataFrame:
    """All rows of the results in which ``column`` is ``value``; other buckets are not opened."""
    folders = [T.StructField("_bucket", T.IntegerType()), T.StructField("_month", T.StringType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *folders])).parquet(index_path)
    wanted = F.lit(value).cast(schema[column].dataType)
    found = rows.where((F.col("_bucket") == bucket_of(wanted, buckets)) & (F.col(column) == wanted) & F.col("date").isNotNull())
    return found.select(*schema.names)
