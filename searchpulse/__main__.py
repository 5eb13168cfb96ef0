"""Job entry points for spark-submit: generate, land, compact, daily, page, compress, check.

Example: spark-submit --py-files searchpulse.zip -m searchpulse daily --log LOG --root OUT --as-of 2024-01-30
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import functions as F

from searchpulse.config import TrendConfig
from searchpulse.operators import quality, reports, serve
from searchpulse.operators.consolidate import canonical_log
from searchpulse.operators.datagen import generate_time_series
from searchpulse.operators.feed import ArrivalFeed
from searchpulse.operators.rank import nest_results
from searchpulse.plans.daily import Tables, run_daily, stored_results
from searchpulse.session import build_session
from searchpulse.sources.files import compress_files
from searchpulse.sources.ingest import land_ndjson
from searchpulse.streaming.compact import FOLDERS, compact_hours
from searchpulse.streaming.land import (
    FLUSH_BYTES,
    FLUSH_SECONDS,
    accepted_rows,
    land_files,
    land_stream,
    landed_events,
    message_files,
)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="searchpulse")
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("generate", help="write a generated search log as NDJSON")
    job.add_argument("--out", required=True)
    job.add_argument("--hours", type=int, default=1)
    job.add_argument("--per-hour", type=int, default=1000)
    job.add_argument("--end", required=True, help="yyyy-MM-dd HH:mm:ss, UTC")
    job.add_argument("--seed", type=int, default=42)

    job = jobs.add_parser("land", help="land a folder of JSON messages as the raw table")
    job.add_argument("--messages", required=True)
    job.add_argument("--table", required=True)
    job.add_argument("--checkpoint", required=True)
    job.add_argument("--by-event-time", action="store_true")
    job.add_argument("--once", action="store_true", help="process what is there and stop")
    job.add_argument("--flush-bytes", type=int, default=FLUSH_BYTES, help="land as soon as this much has arrived")
    job.add_argument("--flush-seconds", type=float, default=FLUSH_SECONDS, help="and after this time in any case")

    job = jobs.add_parser("compact", help="copy landed hours that are over into larger files")
    job.add_argument("--table", required=True)
    job.add_argument("--out", required=True)
    job.add_argument("--before", required=True, help="yyyy-MM-dd HH:mm:ss, UTC")

    job = jobs.add_parser("daily", help="consolidate, cluster, label, rank and store one day")
    job.add_argument("--log", required=True, help="raw table written by land")
    job.add_argument("--root", required=True)
    job.add_argument("--as-of", required=True)
    job.add_argument("--run-ts")
    job.add_argument("--clusters", type=int, default=10)
    job.add_argument("--iterations", type=int, default=20)
    job.add_argument("--true-top", action="store_true", help="rank all queries, not the top of each cluster")
    job.add_argument("--growth", action="store_true")

    job = jobs.add_parser("page", help="print one page of a stored day as JSON")
    job.add_argument("--root", required=True)
    job.add_argument("--date", required=True)
    job.add_argument("--limit")
    job.add_argument("--token")

    job = jobs.add_parser("compress", help="write gzip copies of log files and a size report")
    job.add_argument("--root", required=True)
    job.add_argument("--out", required=True)
    job.add_argument("--report", required=True)

    job = jobs.add_parser("check", help="run the data-quality checks on the stored results")
    job.add_argument("--log", required=True)
    job.add_argument("--root", required=True)
    job.add_argument("--as-of", required=True)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = build_session(f"searchpulse-{args.job}")
    if args.job == "generate":
        log = generate_time_series(spark, args.hours, args.per_hour, args.end, args.seed)
        land_ndjson(log, args.out)
    elif args.job == "land":
        by_event = F.col("timestamp") if args.by_event_time else None
        if args.once:
            messages = message_files(spark, args.messages)
            land_stream(messages, args.table, args.checkpoint, available_now=True, partition_time=by_event).awaitTermination()
        else:
            where = (args.messages, args.table, args.checkpoint)
            land_files(spark, *where, args.flush_bytes, args.flush_seconds, partition_time=by_event)
    elif args.job == "compact":
        print(f"compacted {compact_hours(spark, args.table, args.out, args.before)} folders")
    elif args.job == "daily":
        cfg = TrendConfig(
            cluster_count=args.clusters,
            max_iterations=args.iterations,
            per_cluster=None if args.true_top else TrendConfig.per_cluster,
            with_growth=args.growth,
        )
        run_ts = args.run_ts or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        tables = Tables(args.root)
        feed = ArrivalFeed(spark, args.log, tables.feed, FOLDERS, accepted_rows)
        stored = run_daily(canonical_log(landed_events(spark, args.log)), tables, args.as_of, run_ts, cfg, feed=feed)
        print(f"stored {stored.count()} rows for {args.as_of}")
    elif args.job == "page":
        results = stored_results(spark, Tables(args.root))
        print(serve.page_document(results, args.date, args.limit, args.token).head()["document"])
    elif args.job == "compress":
        compress_files(spark, args.root, args.out).write.mode("overwrite").parquet(args.report)
        reports.compression_summary(spark.read.parquet(args.report)).show(truncate=False)
    elif args.job == "check":
        results = stored_results(spark, Tables(args.root))
        checks = quality.run_suite(
            [
                quality.check_has_data(results),
                quality.check_required(results, ["date", "query", "rank", "count"]),
                quality.check_nested_items(nest_results(results)),
                quality.check_rank_order(results),
                quality.check_result_freshness(results, args.as_of),
                quality.check_event_freshness(landed_events(spark, args.log), f"{args.as_of} 23:59:59"),
            ]
        )
        checks.show(truncate=False)
        return 0 if quality.check_summary(checks).head()["all_passed"] else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
