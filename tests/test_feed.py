"""Change feed over a landed log, and what the daily run redoes with it."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from support import rows, scan_metrics

from searchpulse.config import TrendConfig
from searchpulse.operators.consolidate import canonical_log, consolidate, recompute_touched_days, rows_of_dates, write_by_date
from searchpulse.operators.feed import ArrivalFeed, date_prints
from searchpulse.plans.daily import Tables, consolidate_stage
from searchpulse.streaming.compact import FOLDERS, compact_hours, compacted_events
from searchpulse.streaming.land import accepted_rows

SCHEMA = "timestamp timestamp, user_id string, query_text string, results_count int, click_through boolean, source string, raw string, reject_reason string, outcome string, year int, month int, day int, hour int"


def event(arrived, at, user="u", query="q", outcome="accepted"):
    return (at, user, query, 1, True, "s", None, None, outcome, arrived.year, arrived.month, arrived.day, arrived.hour)


def land(spark, path, *events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").partitionBy(*FOLDERS).parquet(path)


DAY = datetime(2024, 1, 5, 10)


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "raw")
    for d in range(4):
        for h in range(2):
            at = DAY + timedelta(days=d, hours=h)
            land(spark, path, *[event(at, at, f"u{i}", f"q{i % 3}") for i in range(5)], event(at, at, outcome="rejected"))
    return path


def feed_of(spark, path, tmp_path, schema=None):
    return ArrivalFeed(spark, path, str(tmp_path / "state"), FOLDERS, accepted_rows, schema)


def dates(df):
    return sorted(str(r.date) for r in df.collect())


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def make_unreadable(files):
    """Other bytes under the same name, length and time."""
    for f in files:
        stat = os.stat(f)
        with open(f, "wb") as out:
            out.write(b"\0" * stat.st_size)
        os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))
        checksum = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(checksum):
            os.remove(checksum)


def test_feed_reads_new_folders_only(spark, log, tmp_path):
    feed = feed_of(spark, log, tmp_path)
    assert dates(feed.touched_dates()) == ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]
    feed.commit()
    feed = feed_of(spark, log, tmp_path)
    assert dates(feed.touched_dates()) == []
    feed.commit()

    before, schema = files_below(log), spark.read.parquet(log).schema
    late = datetime(2024, 1, 9, 3)
    land(spark, log, event(late, DAY + timedelta(days=1)), event(late, late), event(late, datetime(2023, 12, 1)))
    # the other folders can't be read any more: nothing opens them to find the dates
    kept = [f for f in before if "day=6" in f or "day=9" in f]
    make_unreadable([f for f in before if f not in kept])
    feed = feed_of(spark, log, tmp_path, schema)
    touched = feed.touched_dates().checkpoint()
    assert dates(touched) == ["2023-12-01", "2024-01-06", "2024-01-09"]
    found, files = scan_metrics(feed.rows_of(touched), "numFiles")
    assert len(found) == 13 and max(files) <= 5
    # not committed: a repeated run finds the same
    assert dates(feed_of(spark, log, tmp_path, schema).touched_dates()) == dates(touched)


def test_feed_finds_corrections_and_removed_files(spark, log, tmp_path):
    feed = feed_of(spark, log, tmp_path)
    feed.touched_dates()
    feed.commit()
    target = [f for f in files_below(log) if "day=7" in f and "accepted" in f][0]
    rewritten = str(tmp_path / "rewritten")
    same_size = spark.read.parquet(os.path.dirname(target)).withColumn("query_text", F.lit("other"))
    same_size.coalesce(1).write.parquet(rewritten)
    os.replace(files_below(rewritten)[0], target)
    removed = [f for f in files_below(log) if "day=8" in f and "accepted" in f]
    for f in removed:
        os.remove(f)
    for f in [target, *removed]:
        checksum = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(checksum):
            os.remove(checksum)
    feed = feed_of(spark, log, tmp_path)
    assert dates(feed.touched_dates()) == ["2024-01-07", "2024-01-08"]


def comparable(df):
    return sorted(rows(df.select("date", "query_text", "query_count", "unique_users")), key=str)


def test_consolidation_follows_the_feed(spark, log, tmp_path):
    tables, cfg = Tables(str(tmp_path / "out")), TrendConfig(with_user_sketches=True)

    def go():
        events = canonical_log(accepted_rows(spark.read.parquet(log)))
        consolidate_stage(events, tables, "2024-01-08", cfg, feed=ArrivalFeed(spark, log, tables.feed, FOLDERS, accepted_rows))
        assert comparable(spark.read.parquet(tables.consolidated)) == comparable(consolidate(events))
        assert spark.read.parquet(tables.user_sketches).count() == consolidate(events).count()

    go()
    stamp = {f: os.stat(f).st_mtime_ns for f in files_below(tables.consolidated)}
    go()
    assert {f: os.stat(f).st_mtime_ns for f in files_below(tables.consolidated)} == stamp
    late = datetime(2024, 1, 9, 3)
    land(spark, log, event(late, DAY, "late user"), event(late, datetime(2022, 2, 2)))
    go()
    kept = {f: os.stat(f).st_mtime_ns for f in files_below(tables.consolidated)}
    assert all(kept.get(f) == t for f, t in stamp.items() if "2024-01-05" not in f)
    for f in files_below(log):
        if "day=6" in f and "accepted" in f:
            os.remove(f)
    go()
    assert not os.path.exists(f"{tables.consolidated}/date=2024-01-06")


def test_fingerprints_find_a_correction_without_a_feed(spark, tmp_path):
    tables = Tables(str(tmp_path / "out"))
    old = spark.createDataFrame([(DAY, "u", "a", 1, True, "s"), (DAY, "u", "a", 1, True, "s"), (DAY + timedelta(days=1), "u", "b", 1, True, "s")], "timestamp timestamp, user_id string, query_text string, results_count int, click_through boolean, source string")
    new = old.withColumn("query_text", F.when(F.col("query_text") == "a", "c").otherwise(F.col("query_text")))
    prints = [tuple(r) for r in date_prints(old).orderBy("date").collect()], [tuple(r) for r in date_prints(new).orderBy("date").collect()]
    # the pair of equal rows cancels out in one sum, not in the other
    assert prints[0][0][1:3] == prints[1][0][1:3] == (2, 0) and prints[0][0] != prints[1][0] and prints[0][1] == prints[1][1]
    for state in (old, new, new.where("query_text = 'c'"), old):
        consolidate_stage(state, tables, "2024-01-06")
        assert comparable(spark.read.parquet(tables.consolidated)) == comparable(consolidate(state))
    assert rows(rows_of_dates(old, spark.createDataFrame([(DAY.date(),)], "date date")).select("query_text")) == [("a",), ("a",)]


def test_recompute_reads_touched_partitions_only(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    log = spark.createDataFrame([(DAY + timedelta(days=d), f"u{i}", "q", 1, True, "s") for d in range(4) for i in range(3)], "timestamp timestamp, user_id string, query_text string, results_count int, click_through boolean, source string")
    write_by_date(log.withColumn("date", F.to_date("timestamp")), raw)
    write_by_date(consolidate(log), out)
    late = log.limit(1).withColumn("user_id", F.lit("new"))
    late.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(raw)
    make_unreadable([f for f in files_below(raw) if "2024-01-05" not in f])
    recompute_touched_days(spark, raw, late, out)
    got = {str(r.date): r.unique_users for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-05": 4, "2024-01-06": 3, "2024-01-07": 3, "2024-01-08": 3}


def test_closed_hours_are_compacted_once(spark, log, tmp_path):
    out = str(tmp_path / "compacted")
    at = DAY + timedelta(hours=1)
    land(spark, log, *[event(at, at, f"v{i}") for i in range(4)])
    whole = accepted_rows(spark.read.parquet(log)).drop("outcome")
    want = sorted(rows(whole), key=str)
    assert sorted(rows(compacted_events(spark, log, out)), key=str) == want
    assert compact_hours(spark, log, out, "2024-01-07 10:59:59") == 8
    assert compact_hours(spark, log, out, "2024-01-07 10:59:59") == 0
    got = compacted_events(spark, log, out)
    assert sorted(rows(got.select(whole.columns)), key=str) == want
    hour = f"{out}/outcome=accepted/year=2024/month=1/day=5/hour=11"
    assert len(files_below(hour)) == 1 and not os.path.exists(f"{out}/outcome=accepted/year=2024/month=1/day=7")
    assert compact_hours(spark, log, out, "2025-01-01 00:00:00") == 8
    assert sorted(rows(compacted_events(spark, log, out).select(whole.columns)), key=str) == want
