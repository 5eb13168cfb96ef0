"""Wire format, rejects, landed files, schema discovery, publishing, re-encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchpulse.operators import quality
from searchpulse.operators.consolidate import consolidate, write_by_date
from searchpulse.plans.registry import DAILY_SQL, LOG_SQL, query
from searchpulse.session import work_dir
from searchpulse.sources import ingest
from searchpulse.sources.files import compress_files
from searchpulse.sources.fixtures import search_log, table

WIRE_SQL = f"SELECT *, CAST(floor(results_count) AS INTEGER) AS results FROM ({LOG_SQL})"


def wire_log(log: DataFrame) -> DataFrame:
    return log.withColumn("results_count", F.floor("results_count").cast("int"))


def messages_with_defects(log: DataFrame) -> DataFrame:
    """Wire messages in which some sources send a bad time or broken JSON."""
    sent = ingest.to_wire(wire_log(log), "source")
    bad_time = F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"yesterday"')
    broken = F.concat(F.lit("{"), F.col("value"))
    value = F.when(F.col("source") == "error", bad_time).when(F.col("source") == "signup", broken).otherwise(F.col("value"))
    return sent.select("key", value.alias("value"))


REJECT_SQL = f"""
SELECT 'accepted' AS outcome, CAST(ts AS DATE) AS date, query_text, count(*) AS messages, CAST(sum(results) AS BIGINT) AS results
FROM ({WIRE_SQL}) WHERE source NOT IN ('error', 'signup') GROUP BY 2, 3
UNION ALL
SELECT CASE WHEN source = 'error' THEN 'bad timestamp' ELSE 'unreadable record' END, NULL, NULL, count(*), 0
FROM ({WIRE_SQL}) WHERE source IN ('error', 'signup') GROUP BY 1
"""


@query("reject_split", REJECT_SQL)
def reject_split(spark, sf_dir):
    good, bad = ingest.split_rejects(ingest.parse_wire(messages_with_defects(search_log(spark, sf_dir))))
    return summarise(good, bad)


def summarise(good: DataFrame, bad: DataFrame) -> DataFrame:
    accepted = good.groupBy(F.to_date("timestamp").alias("date"), "query_text").agg(
        F.count("*").alias("messages"), F.sum("results_count").alias("results")
    )
    rejected = bad.groupBy("reject_reason").agg(F.count("*").alias("messages"))
    return accepted.select(F.lit("accepted").alias("outcome"), "*").unionByName(
        rejected.select(
            F.col("reject_reason").alias("outcome"),
            F.lit(None).cast("date").alias("date"),
            F.lit(None).cast("string").alias("query_text"),
            "messages",
            F.lit(0).cast("long").alias("results"),
        )
    )


@query("ndjson_roundtrip", f"""
SELECT event_id, user_id, query_text, results, source, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
       strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour
FROM ({WIRE_SQL})
""")
def ndjson_roundtrip(spark, sf_dir):
    path = work_dir(spark, "ndjson")
    log = wire_log(search_log(spark, sf_dir)).withColumnRenamed("results_count", "results")
    ingest.land_ndjson(log, path)
    fields = ["event_id", "user_id", "query_text", "results", "source"]
    schema = T.StructType([log.schema[f] for f in fields])
    return ingest.read_ndjson(spark, path, schema)


@query("publish_keyed", f"SELECT user_id AS key, count(*) AS messages FROM ({LOG_SQL}) GROUP BY user_id")
def publish_keyed(spark, sf_dir):
    path = work_dir(spark, "published")
    ingest.publish_keyed(wire_log(search_log(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("key").agg(F.count("value").alias("messages"))


@query("publish_batches", f"""
SELECT count(*) AS total, count(*) FILTER (source <> 'error') AS success, count(*) FILTER (source = 'error') AS failed
FROM ({LOG_SQL})
""")
def publish_batches(spark, sf_dir):
    """Records of one kind have no key and are not published; the summary counts what was written."""
    log = wire_log(search_log(spark, sf_dir))
    log = log.withColumn("user_id", F.when(F.col("source") != "error", F.col("user_id")))
    path = work_dir(spark, "published")
    ingest.publish_keyed(log, path)
    return ingest.publish_summary(log, spark.read.parquet(path))


DISCOVER_SQL = f"""
SELECT event_id, query_text, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN source END AS source, CAST(day(ts) AS INTEGER) AS day
FROM ({LOG_SQL})
"""


def _two_generations(spark, sf_dir) -> str:
    """Files of the first half of the month lack the column ``source``."""
    path = work_dir(spark, "generations")
    log = search_log(spark, sf_dir).withColumn("day", F.dayofmonth("timestamp"))
    cut = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz")
    log.where(cut).select("event_id", "query_text", "day").write.partitionBy("day").parquet(path)
    log.where(~cut).select("event_id", "query_text", "source", "day").write.mode("append").partitionBy("day").parquet(path)
    log.limit(1).select("event_id").write.parquet(f"{path}/{ingest.ERRORS}")
    return path


@query("catalogued_scan", f"SELECT query_text, date, query_count, unique_users, click_through_rate FROM ({DAILY_SQL})")
def catalogued_scan(spark, sf_dir):
    """Consolidation of a raw log read through the catalogue."""
    path, name = work_dir(spark, "raw-table"), f"raw_{uuid.uuid4().hex[:12]}"
    log = search_log(spark, sf_dir).withColumn("date", F.to_date("timestamp"))
    write_by_date(log, path)
    daily = consolidate(ingest.register_table(spark, name, path).drop("date"))
    return daily.select("query_text", "date", "query_count", "unique_users", "click_through_rate")


@query("discover_schema", DISCOVER_SQL)
def discover_schema(spark, sf_dir):
    return ingest.discover(spark, _two_generations(spark, sf_dir))


WIDENED_SQL = f"""
SELECT event_id, query_text, CASE WHEN day(ts) < 11 THEN CAST(k AS VARCHAR) WHEN day(ts) < 21 THEN CAST(k / 4 AS VARCHAR) ELSE 'n' || k END AS amount,
       CAST(k AS DOUBLE) / CASE WHEN day(ts) < 21 THEN 1 ELSE 4 END AS weight, CAST(day(ts) AS INTEGER) AS day
FROM ({LOG_SQL})
"""


@query("discover_widened", WIDENED_SQL)
def discover_widened(spark, sf_dir):
    """A column that is a whole number, then a fraction, then text, and one that is int, then long, then a fraction."""
    path = work_dir(spark, "retyped")
    k = F.element_at(F.split("query_text", " "), -1).cast("int")
    log = search_log(spark, sf_dir).select("event_id", "query_text", k.alias("k"), F.dayofmonth("timestamp").alias("day"))
    kinds = [
        (F.col("day") < 11, F.col("k"), F.col("k")),
        (F.col("day").between(11, 20), F.col("k") / 4, F.col("k").cast("long")),
        (F.col("day") > 20, F.concat(F.lit("n"), "k"), F.col("k") / 4),
    ]
    for part, amount, weight in kinds:
        rows = log.where(part).select("event_id", "query_text", amount.alias("amount"), weight.alias("weight"), "day")
        rows.write.mode("append").partitionBy("day").parquet(path)
    return ingest.discover_widened(spark, path)[0].select("event_id", "query_text", "amount", "weight", "day")


@query("check_partitions", "SELECT 'partitions' AS validation, count(*) > 0 AS success, 'misplaced: 0, empty: 0' AS details FROM events")
def check_partitions(spark, sf_dir):
    path = work_dir(spark, "daily")
    write_by_date(consolidate(search_log(spark, sf_dir)), path)
    return quality.check_partitions(spark, path, ("date",))


@query("compress_files", """
SELECT 'compressed/year=2024/month=01/day=' || strftime(ts, '%d') AS folder, count(*) AS lines,
       CAST(sum(length(props) + 1) AS BIGINT) AS original_size, true AS smaller
FROM events GROUP BY 1
""")
def compress_files_query(spark, sf_dir):
    """Land the event texts as daily files, re-encode them, and read the copies back."""
    root, out = work_dir(spark, "plain"), work_dir(spark, "gzip")
    events = table(spark, sf_dir, "events")
    dated = events.select("props", *[F.date_format("ts", p).alias(n) for n, p in [("year", "yyyy"), ("month", "MM"), ("day", "dd")]])
    dated.hint("rebalance", "year", "month", "day").write.partitionBy("year", "month", "day").text(f"{root}/raw-data")
    folder = F.regexp_replace("compressed_key", "/[^/]+$", "")
    # The report is written first: the copies exist once it is complete.
    report = f"{out}-report"
    compress_files(spark, root, out).write.parquet(report)
    sizes = (
        spark.read.parquet(report)
        .where("success")
        .groupBy(folder.alias("folder"))
        .agg(F.sum("original_size").alias("original_size"), (F.sum("compressed_size") < F.sum("original_size")).alias("smaller"))
    )
    copies = spark.read.option("recursiveFileLookup", "true").text(f"{out}/compressed").select(F.input_file_name().alias("path"))
    lines = copies.groupBy(F.regexp_extract("path", "(compressed/.*)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("lines"))
    return lines.join(sizes, "folder").select("folder", "lines", "original_size", "smaller")
