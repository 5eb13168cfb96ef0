"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the number of local cores. Every query is run to completion into a
sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from searchpulse.plans import all_queries  # noqa: E402
from searchpulse.plans.landing_queries import wire_log  # noqa: E402
from searchpulse.session import build_session, work_dir  # noqa: E402
from searchpulse.sources.fixtures import search_log  # noqa: E402
from searchpulse.sources.ingest import to_wire  # noqa: E402
from searchpulse.streaming.land import arrived_bytes, land_files  # noqa: E402

HEADLINE = [
    "consolidate",
    "recent_high_volume",
    "growth_rate",
    "top_per_cluster",
    "trending_rank",
    "trending_by_day",
    "consolidate_write",
    "store_results",
    "reject_split",
    "ndjson_roundtrip",
    "land_stream",
    "stream_late_rows",
    "late_recompute",
    "compress_files",
    "tokens",
    "term_idf",
    "term_tfidf",
    "cluster_queries",
    "label_clusters",
    "percentile_floor",
    "latency_report",
    "metric_windows",
    "alarm_transitions",
    "gen_log",
    "store_served",
    "page_first",
    "page_next",
    "by_category",
    "purge_apply",
    "expired_removed",
    "users_between",
    "quantile_sketches",
    "discover_widened",
    "default_alarms",
    "clustering_cost",
    "stream_consolidate",
    "alarm_stream",
    "daily_trends",
]


def landing_rate(spark, sf_dir: str) -> float:
    """MB of messages that a backlog in files lands each second, in batches of at most 4 MB."""
    source, table = work_dir(spark, "backlog"), work_dir(spark, "landed")
    to_wire(wire_log(search_log(spark, sf_dir))).select("value").repartition(16).write.text(source)
    there, begun = arrived_bytes(spark, source), time.perf_counter()
    turns = iter([False, True])
    land_files(spark, source, table, f"{table}-checkpoint", max_bytes=4 << 20, stop=lambda: next(turns))
    return round(there / 1e6 / (time.perf_counter() - begun), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "searchpulse-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="searchpulse-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # the pages read a stored table; storing it is timed apart from reading
    queries["store_served"] = queries["trending_by_date"]
    queries["consolidate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rate = landing_rate(spark, sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "landing_mb_per_sec": rate,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
