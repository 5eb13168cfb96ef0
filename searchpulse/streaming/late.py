"""A query-day table of an event stream in which late events count.

Each micro-batch is reduced to one row per query, day, user and source and stored by
day. A day is closed when the watermark (the latest event time before the batch, less a
delay) has passed its end; its query-days are then written. Rows of days that
were closed before their batch go to a table of their own, and ``merge_late`` redoes the
days they belong to. Everything is named by the batch that wrote it, so a batch that is repeated
overwrites itself; no state is held in memory, and distinct users stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from searchpulse.functions.joins import counted_side
from searchpulse.operators.consolidate import daily_rows, reduce_log, write_by_date
from searchpulse.schemas import CONSOLIDATED
from searchpulse.session import ensure_checkpoint_dir


STORED = (
    "query_text string, user_id string, source string, n long, results double, with_results long, clicks long, "
    "first decimal(38,0), batch long, date date"
)


@dataclass(frozen=True)
class StreamTables:
    """Where the stream keeps what it needs, below one root."""

    root: str

    @property
    def on_time(self) -> str:
        return f"{self.root}/on-time"

    @property
    def late(self) -> str:
        return f"{self.root}/late"

    @property
    def marks(self) -> str:
        return f"{self.root}/marks"

    @property
    def merged(self) -> str:
        return f"{self.root}/merged"

    @property
    def daily(self) -> str:
        return f"{self.root}/daily"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class LateAwareDays:
    """The stream's writer; ``delay`` is the watermark's, in seconds."""

    def __init__(self, tables: StreamTables, delay: int = 86_400):
        self.tables, self.delay = tables, delay

    def start(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return log.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    # one batch

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        spark, tables = rows.sparkSession, self.tables
        before = self._watermark(spark, batch_id - 1)
        reduced = reduce_log(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")), last=F.max("timestamp")).persist()
        try:
            last = reduced.agg(F.max(F.unix_micros("last"))).head()[0]
            closed = self._closed(before)
            self._store(reduced.where(~closed), tables.on_time, batch_id)
            self._store(reduced.where(closed), tables.late, batch_id)
            marks = spark.createDataFrame([(last,)], "last long")
            marks.coalesce(1).write.mode("overwrite").parquet(f"{tables.marks}/batch={batch_id}")
        finally:
            reduced.unpersist()
        after = self._watermark(spark, batch_id)
        if after != before:
            self._write_days(spark, ~self._closed(before) & self._closed(after))

    @staticmethod
    def _closed(watermark: int | None):
        """Whether the end of a row's date lies at or before the watermark (microseconds)."""
        if watermark is None:
            return F.lit(False)
        return F.coalesce(F.unix_micros(F.date_add("date", 1).cast("timestamp")) <= F.lit(watermark), F.lit(False))

    def _watermark(self, spark: SparkSession, upto: int) -> int | None:
        """Latest event time of all batches up to a number, less the delay."""
        if not _exists(spark, self.tables.marks):
            return None
        marks = spark.read.schema("last long, batch long").parquet(self.tables.marks).where(F.col("batch") <= upto)
        last = marks.agg(F.max("last")).head()[0]
        return None if last is None else last - self.delay * 1_000_000

    @staticmethod
    def _store(reduced: DataFrame, path: str, batch_id: int) -> None:
        """Rows of one batch, replacing what an earlier attempt has written."""
        kept = reduced.drop("last").withColumn("results", F.col("results").cast("double"))
        kept.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={batch_id}")

    # days

    def _stored(self, spark: SparkSession, path: str) -> DataFrame | None:
        """All batches of a table, with the date and the batch as folder columns."""
        return spark.read.schema(STORED).parquet(path) if _exists(spark, path) else None

    def _write_days(self, spark: SparkSession, wanted) -> None:
        """Redo the query-days of the dates that ``wanted`` allows, late rows included."""
        days = (self._stored(spark, p) for p in (self.tables.on_time, self.tables.late))
        parts = [
            d.where(wanted).withColumn("late", F.lit(is_late)) for d, is_late in zip(days, (0, 1)) if d is not None
        ]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        write_by_date(daily_rows(rows, late_rows=F.sum(F.col("n") * F.col("late"))), self.tables.daily)

    def merge_late(self, spark: SparkSession) -> int:
        """Redo the closed days with late rows since the last merge; returns their number."""
        ensure_checkpoint_dir(spark)
        late = self._stored(spark, self.tables.late)
        if late is None:
            return 0
        done = -1
        if _exists(spark, self.tables.merged):
            done = spark.read.schema("upto long").parquet(self.tables.merged).agg(F.max("upto")).head()[0]
        news = late.where(F.col("batch") > done)
        touched = news.select("date").distinct().checkpoint()
        number = touched.count()
        if number:
            upto = news.agg(F.max("batch")).head()[0]
            dates = counted_side(touched.select(F.col("date").alias("_date")))
            for_days = [
                d.join(dates, F.col("date") == F.col("_date"), "left_semi").withColumn("late", F.lit(is_late))
                for d, is_late in ((self._stored(spark, self.tables.on_time), 0), (late, 1))
            ]
            rows = for_days[0].unionByName(for_days[1])
            write_by_date(daily_rows(rows, late_rows=F.sum(F.col("n") * F.col("late"))), self.tables.daily)
            spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(self.tables.merged)
        return number

    def close_all(self, spark: SparkSession) -> None:
        """At the end of a stream: merge what is late and write the days that are still open."""
        self.merge_late(spark)
        self._write_days(spark, ~self._closed(self._watermark(spark, 1 << 62)))


def late_aware_daily(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """The stored query-days with ``late_rows``, the late events that each one holds."""
    schema = T.StructType([*CONSOLIDATED.fields, T.StructField("late_rows", T.LongType())])
    return spark.read.schema(schema).parquet(tables.daily)
