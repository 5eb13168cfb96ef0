"""Landing by size or time, and stream days in which late rows count."""

import json
import os
import random
import threading
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from support import rows

from searchpulse.operators.consolidate import consolidate
from searchpulse.schemas import SEARCH_EVENT
from searchpulse.streaming.land import flush_options, land_files, landed_events
from searchpulse.streaming.late import LateAwareDays, StreamTables, late_aware_daily

PAD = "x" * 400


def write_messages(folder, name, first, count):
    os.makedirs(folder, exist_ok=True)
    lines = [json.dumps({"event_id": i, "timestamp": "2024-01-01T05:00:00Z", "query": f"q{i % 7} {PAD}"}) for i in range(first, first + count)]
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(lines) + "\n")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def landed(spark, out):
    return landed_events(spark, out).count() if os.path.exists(f"{out}/_spark_metadata/0") else 0


def test_a_backlog_lands_back_to_back_and_a_trickle_within_the_interval(spark, tmp_path):
    src, out, interval = str(tmp_path / "src"), str(tmp_path / "out"), 60
    for k in range(20):  # 100 MB in files of 5 MB
        write_messages(src, f"f{k}.json", k * 11_000, 11_000)
    size = sum(os.path.getsize(f"{src}/{f}") for f in os.listdir(src))
    assert size > 100e6
    seen, done = {}, threading.Event()

    def follow():
        """A trickle once the backlog has landed, then more than the size at once."""
        begun = time.monotonic()
        while landed(spark, out) < 220_000:
            time.sleep(0.3)
        seen["backlog"] = time.monotonic() - begun
        write_messages(src, "trickle.json", 900_000, 10)
        time.sleep(3)
        seen["early"] = landed(spark, out) - 220_000
        write_messages(src, "burst.json", 910_000, 14_000)
        burst = time.monotonic()
        while landed(spark, out) < 234_010:
            time.sleep(0.3)
        seen["burst"] = time.monotonic() - burst
        done.set()

    thread = threading.Thread(target=follow, daemon=True)
    thread.start()
    limit = time.monotonic() + 200
    stop = lambda: done.is_set() or time.monotonic() > limit
    flushes = land_files(spark, src, out, f"{out}-cp", flush_seconds=interval, max_bytes=20_000_000, stop=stop, poll_seconds=0.2)
    assert done.is_set() and seen["backlog"] < interval and seen["early"] == 0 and seen["burst"] < interval / 2
    assert flushes == 2
    batches = [f for f in os.listdir(f"{out}/_spark_metadata") if f.isdigit()]
    assert len(batches) >= 6  # the backlog in batches of at most 20 MB
    assert landed_events(spark, out).select("event_id").distinct().count() == 234_010


def test_a_trickle_waits_for_the_interval_only(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    started = time.monotonic()
    write_messages(src, "a.json", 0, 5)
    state = {"second": None}

    def stop():
        n = landed(spark, out)
        if n == 5 and state["second"] is None:
            write_messages(src, "b.json", 5, 5)
            state["second"] = time.monotonic()
        if n == 10:
            state["landed"] = time.monotonic()
        return n == 10 or time.monotonic() - started > 90

    assert land_files(spark, src, out, f"{out}-cp", flush_seconds=6, stop=stop, poll_seconds=0.2) == 2
    assert state["landed"] - state["second"] < 20
    # started again, the checkpoint knows what has been landed
    calls = iter([False, False, True])
    assert land_files(spark, src, out, f"{out}-cp", flush_seconds=600, stop=lambda: next(calls), poll_seconds=0.1) == 1
    assert landed(spark, out) == 10


def test_nothing_to_land(spark, tmp_path):
    calls = iter([False, False, True])
    assert land_files(spark, str(tmp_path / "none"), str(tmp_path / "out"), str(tmp_path / "cp"), stop=lambda: next(calls), poll_seconds=0.01) == 0
    assert flush_options(500) == {"minOffsetsPerTrigger": "500", "maxTriggerDelay": "300s"}


def batches():
    """Four loads; in the later ones a fifth of the rows lie days back."""
    rng, t0, out = random.Random(5), datetime(2024, 1, 1), []
    for b in range(4):
        load = []
        for i in range(200):
            at = t0 + timedelta(days=2 * b, hours=rng.random() * 48)
            if b and rng.random() < 0.2:
                at = t0 + timedelta(hours=rng.random() * 48 * b)
            user = None if i % 40 == 0 else f"u{rng.randint(1, 9)}"
            load.append((b * 1000 + i, at, user, "s", rng.choice(["hot", "hot", "q1", None]), None if i % 30 == 0 else rng.randint(0, 9), rng.random() < 0.5, f"src{i % 3}"))
        out.append(load)
    out[2].append((9999, None, "u1", "s", "undated", 1, True, "src0"))
    return out


def comparable(df):
    columns = ["query_text", "date", "query_count", "unique_users", F.round("avg_results_count", 9), "click_through_rate", "source"]
    return sorted(rows(df.select(*columns)), key=str)


def test_stream_with_late_rows_equals_the_batch(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "days")
    days, every, late, watermark = LateAwareDays(StreamTables(root), delay=3600), [], {}, None
    for b, load in enumerate(batches()):
        for row in load:
            if row[1] is not None and watermark is not None and datetime(row[1].year, row[1].month, row[1].day) + timedelta(days=1) <= watermark:
                late[row[4], row[1].date()] = late.get((row[4], row[1].date()), 0) + 1
        every += load
        spark.createDataFrame(load, SEARCH_EVENT).coalesce(1).write.mode("append").parquet(src)
        days.start(spark.readStream.schema(SEARCH_EVENT).parquet(src), f"{root}/cp", availableNow=True).awaitTermination()
        watermark = max(r[1] for r in every if r[1] is not None) - timedelta(hours=1)
        closed = {str(r.date) for r in late_aware_daily(spark, days.tables).select("date").distinct().collect()} if b else set()
        assert all(datetime.fromisoformat(d) + timedelta(days=1) <= watermark for d in closed)
        if b == 2:  # a batch that is repeated changes nothing
            again = spark.createDataFrame(load, SEARCH_EVENT)
            days.batch(again, b)
            days.merge_late(spark)
            assert days.merge_late(spark) == 0
    whole = consolidate(spark.createDataFrame(every, SEARCH_EVENT))
    before = late_aware_daily(spark, days.tables)
    assert comparable(before) != comparable(whole)
    days.close_all(spark)
    got = late_aware_daily(spark, days.tables)
    assert comparable(got) == comparable(whole)
    assert sum(late.values()) > 50
    assert {(r.query_text, r.date): r.late_rows for r in got.where("late_rows > 0").collect()} == late


def test_stream_without_rows(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "days")
    spark.createDataFrame([], SEARCH_EVENT).write.parquet(src)
    days = LateAwareDays(StreamTables(root))
    days.batch(spark.read.schema(SEARCH_EVENT).parquet(src), 0)
    assert days.merge_late(spark) == 0
    days.close_all(spark)
    assert spark.read.schema("query_text string").parquet(days.tables.daily).count() == 0
