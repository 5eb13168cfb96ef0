"""Continuous landing: messages to partitioned Parquet, rejects in a partition of their own.

What has arrived is flushed once it has reached a size or an age, whichever comes
first. A topic's source knows both conditions itself (``flush_options``); over files
``land_files`` runs the landing query for all that is there whenever one is met. A
backlog is landed in bounded batches that follow each other without a pause.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from searchpulse.sources.ingest import HOUR_PARTITIONS, parse_wire, with_hour_partitions

ACCEPTED, REJECTED = "accepted", "rejected"
FILES_PER_FOLDER = 4
#: What has arrived is flushed at this size or age.
FLUSH_BYTES, FLUSH_SECONDS = 5 << 20, 300
#: Bytes that one batch of a backlog holds for each core.
CORE_BYTES = 64 << 20


def message_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Stream of the text files below ``path``, one message a line, at most ``max_bytes`` a batch (or one file).

    By default a batch follows the cluster: ``CORE_BYTES`` for each of its cores.
    """
    limit = max_bytes or CORE_BYTES * spark.sparkContext.defaultParallelism
    reader = spark.readStream.option("recursiveFileLookup", "true").option("maxBytesPerTrigger", limit)
    return reader.text(path)


def flush_options(records: int, seconds: int = FLUSH_SECONDS) -> dict[str, str]:
    """The two conditions for a topic's source: it gives a batch once ``records`` are waiting, or after ``seconds``.

    Run such a stream with an interval of 0 seconds, so that a backlog does not wait either.
    """
    return {"minOffsetsPerTrigger": str(records), "maxTriggerDelay": f"{seconds}s"}


def landing_rows(messages: DataFrame, partition_time: Column | None = None) -> DataFrame:
    """Parsed events with their folder columns; rejects keep the raw text and the reason.

    Folders follow the delivery time by default. ``partition_time`` (an expression
    on the parsed event) follows the event time instead; rejects, which may have
    none, are then filed by delivery time.
    """
    parsed = parse_wire(messages)
    good = F.col("reject_reason").isNull()
    filed = F.current_timestamp() if partition_time is None else F.coalesce(partition_time, F.current_timestamp())
    rows = parsed.withColumns(
        {
            "raw": F.when(~good, F.col("raw")),
            "outcome": F.when(good, F.lit(ACCEPTED)).otherwise(F.lit(REJECTED)),
        }
    )
    return with_hour_partitions(rows, filed)


def land_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    interval: str = "300 seconds",
    available_now: bool = False,
    partition_time: Column | None = None,
) -> StreamingQuery:
    """Start the landing query on a stream of JSON messages (column ``value``).

    One pass over the messages writes both outcomes: the file sink commits every
    micro-batch exactly once, and readers of one outcome prune the other's folders.
    A batch writes at most ``FILES_PER_FOLDER`` files into a folder: rows are dealt by
    folder and a hash, so neither many tasks write one folder nor one task writes a
    large one.
    """
    rows = landing_rows(messages, partition_time)
    dealt = F.pmod(F.xxhash64("raw", *[c for c in ("user_id", "event_id", "query_text") if c in rows.columns]), F.lit(FILES_PER_FOLDER))
    writer = (
        rows.repartition("outcome", *HOUR_PARTITIONS, dealt)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("outcome", *HOUR_PARTITIONS)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(path)


def arrived_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``; none if it is not there yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getContentSummary(root).getLength() if store.exists(root) else 0


def land_files(
    spark: SparkSession,
    messages: str,
    path: str,
    checkpoint: str,
    flush_bytes: int = FLUSH_BYTES,
    flush_seconds: float = FLUSH_SECONDS,
    max_bytes: int | None = None,
    partition_time: Column | None = None,
    stop: Callable[[], bool] = lambda: False,
    poll_seconds: float = 5.0,
) -> int:
    """Land the files that arrive below ``messages`` until ``stop`` says so; returns the number of flushes.

    A flush lands everything that is there, in batches of at most ``max_bytes`` one
    after the other. The next starts as soon as ``flush_bytes`` have arrived since,
    or when anything has arrived and ``flush_seconds`` have passed since the last one
    began. Files removed meanwhile (by the source's clean-up) only lower the mark.
    """
    flushed, mark, began, first = 0, 0, 0.0, True
    while not stop():
        now, there = time.monotonic(), arrived_bytes(spark, messages)
        mark = min(mark, there)
        # at the start the checkpoint tells what has been landed: look once
        if there > mark and (first or there - mark >= flush_bytes or now - began >= flush_seconds):
            stream = message_files(spark, messages, max_bytes)
            land_stream(stream, path, checkpoint, available_now=True, partition_time=partition_time).awaitTermination()
            flushed, mark, began, first = flushed + 1, there, now, False
        else:
            time.sleep(poll_seconds)
    return flushed


def landed_events(spark: SparkSession, path: str) -> DataFrame:
    """The raw search log: good events only."""
    return accepted_rows(spark.read.parquet(path)).drop("outcome")


def accepted_rows(stored: DataFrame) -> DataFrame:
    """The good rows of a landed table, with their folder columns."""
    return stored.where(F.col("outcome") == ACCEPTED).drop("raw", "reject_reason")


def landed_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("outcome") == REJECTED).select("raw", "reject_reason")
