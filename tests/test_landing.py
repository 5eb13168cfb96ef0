import gzip
import json
import os
from datetime import datetime

import pytest
from support import rows
from pyspark.sql import functions as F

from searchpulse.functions import keys
from searchpulse.operators import quality
from searchpulse.operators.consolidate import consolidate
from searchpulse.schemas import SEARCH_EVENT
from searchpulse.sources import files, ingest


def message(**fields):
    base = {"event_id": 1, "timestamp": "2025-01-05T23:30:00Z", "user_id": "u1", "query": "q", "results_count": 3, "click_through": True, "source": "s"}
    return json.dumps({**base, **fields})


def parsed(spark, *texts):
    return ingest.parse_wire(spark.createDataFrame([(t,) for t in texts], "value string"))


def test_good_and_rejected_messages(spark):
    good, bad = ingest.split_rejects(
        parsed(spark, message(), message(timestamp="05/01/2025"), "{broken", message(results_count="many"), message(query=None, query_text="t"))
    )
    assert sorted(r.query_text for r in good.collect()) == ["q", "t"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["bad timestamp", "unreadable record", "unreadable record"]
    assert "{broken" in {r.raw for r in bad.collect()}


def test_offsets_are_shifted_to_utc_days(spark):
    good, _ = ingest.split_rejects(parsed(spark, message(timestamp="2025-10-03T23:30:00-05:00")))
    assert str(good.select(F.to_date("timestamp").alias("d")).head().d) == "2025-10-04"


def test_wire_roundtrip(spark):
    log = spark.createDataFrame([(7, datetime(2024, 1, 2, 3, 4, 5, 678), "u", "s", "text", 5, True, "src")], SEARCH_EVENT)
    sent = ingest.to_wire(log)
    assert sent.head().key == "u" and json.loads(sent.head().value)["timestamp"] == "2024-01-02T03:04:05.000678Z"
    good, _ = ingest.split_rejects(ingest.parse_wire(sent))
    assert rows(good.select(log.columns)) == rows(log)


def test_ndjson_layout_and_partition_check(spark, tmp_path):
    path = str(tmp_path / "landed")
    log = spark.createDataFrame([(1, datetime(2024, 1, 2, 3), "q"), (2, datetime(2024, 11, 12, 13), "r")], "event_id long, timestamp timestamp, query_text string")
    ingest.land_ndjson(log, path)
    assert os.path.isdir(f"{path}/year=2024/month=01/day=02/hour=03")
    back = ingest.read_ndjson(spark, path, log.schema)
    assert sorted(rows(back.select("event_id", "query_text", "month", "hour"))) == [(1, "q", "01", "03"), (2, "r", "11", "13")]
    assert quality.check_partitions(spark, path).head().success
    open(f"{path}/stray.json", "w").close()
    check = quality.check_partitions(spark, path).head()
    assert not check.success and check.details == "misplaced: 1, empty: 1"


def test_schema_discovery_and_catalogue(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "id long, day string").write.partitionBy("day").parquet(path)
    table = ingest.register_table(spark, "search_events_test", path)
    assert table.count() == 1 and "extra" not in table.columns
    spark.createDataFrame([(2, 2.5, "b")], "id long, extra double, day string").write.mode("append").partitionBy("day").parquet(path)
    assert sorted(map(str, rows(ingest.discover(spark, path).select("id", "extra", "day")))) == ["(1, None, 'a')", "(2, 2.5, 'b')"]
    again = ingest.register_table(spark, "search_events_test", path)
    assert sorted(map(str, rows(again.select("id", "extra", "day")))) == ["(1, None, 'a')", "(2, 2.5, 'b')"]
    plan = again.where("day = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    spark.sql("drop table search_events_test")


def test_catalogued_log_feeds_the_consolidation(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.createDataFrame([(i, datetime(2024, 1, 1), f"u{i % 2}", "s", "q", 1, True, "x") for i in range(6)], SEARCH_EVENT)
    log.write.parquet(path)
    row = consolidate(ingest.register_table(spark, "log_for_daily_test", path)).head()
    assert (row.query_count, row.unique_users) == (6, 2)
    spark.sql("drop table log_for_daily_test")


def test_summary_counts_what_was_written(spark):
    sent, written = spark.range(10), spark.range(7)
    assert rows(ingest.publish_summary(sent, written)) == [(10, 7, 3)]
    assert rows(ingest.publish_summary(sent.where("false"), written.where("false"))) == [(0, 0, 0)]


def test_errors_are_no_part_of_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(3).withColumn("day", F.lit(1)).write.partitionBy("day").parquet(root)
    spark.range(5).select(F.col("id").alias("broken")).write.parquet(f"{root}/errors")
    assert ingest.discover(spark, root).columns == ["id", "day"] and ingest.discover(spark, root).count() == 3


def test_an_empty_message_is_unreadable(spark):
    df = spark.createDataFrame([("",), (" ",)], "value string")
    assert {r.reject_reason for r in ingest.parse_wire(df).collect()} == {"unreadable record"}


KEYS = {
    "raw-data/year=2024/month=01/day=02/a.json": ("compressed/year=2024/month=01/day=02/a.json.gz", True),
    "logs/x/y.bin": ("compressed/y.bin.gz", True),
    "img/a.PNG": ("compressed/a.PNG.gz", False),
    "img/a.LOG": ("compressed/a.LOG.gz", True),
    "Search-Queries/hour=03/z": ("compressed/hour=03/z.gz", True),
    "compressed/a.json": ("compressed/a.json.gz", False),
    "logs/a.gz": ("compressed/a.gz.gz", False),
    "plain.txt": ("compressed/plain.txt.gz", True),
}


def test_key_rules(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "key string")
    got = df.select("key", keys.compressed_key(F.col("key")), keys.needs_compression(F.col("key")))
    assert {k: (c, n) for k, c, n in rows(got)} == KEYS
    plain = spark.createDataFrame([("a/b.log",), ("a/b.gz",)], "key string").select(keys.compressed_key(F.col("key"), ""))
    assert rows(plain) == [("a/b.log.gz",), ("a/b.gz",)]


def write(root, name, data):
    target = os.path.join(root, name)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as f:
        f.write(data)


def test_files_are_reencoded_one_to_one(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    big = b"line of text\n" * 300_000
    write(root, "raw-data/year=2024/month=01/day=02/a.json", big)
    write(root, "logs/empty.log", b"")
    write(root, "img/skip.png", b"x")
    write(root, "logs/_app.log", b"a")
    write(root, "_sent/logs/.c.log", b"b")
    got = {r.key: r for r in files.compress_files(spark, root, out).collect()}
    hidden = {"logs/_app.log", "_sent/logs/.c.log"}
    assert set(got) == {"raw-data/year=2024/month=01/day=02/a.json", "logs/empty.log"} | hidden
    a = got["raw-data/year=2024/month=01/day=02/a.json"]
    assert a.success and a.original_size == len(big) and a.compressed_size < len(big) // 100
    with gzip.open(os.path.join(out, a.compressed_key)) as f:
        assert f.read() == big
    assert os.path.exists(os.path.join(root, a.key))
    assert got["logs/empty.log"].compression_ratio == 0.0
    assert not [n for _, _, names in os.walk(out) for n in names if n.endswith(".part")]


def test_colliding_targets_stop_before_writing(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, "logs/a/day=01/x.log", b"1")
    write(root, "logs/b/day=01/x.log", b"2")
    with pytest.raises(files.KeyCollision):
        files.compress_files(spark, root, out)
    assert not os.path.exists(out)
