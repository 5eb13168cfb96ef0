import json
import random
from datetime import datetime, timedelta

import pytest
from support import rows
from pyspark.sql import functions as F

from searchpulse.operators import metrics
from searchpulse.operators.consolidate import consolidate
from searchpulse.operators.metrics import AlarmRule
from searchpulse.schemas import SEARCH_EVENT
from searchpulse.streaming.alarms import alarm_stream, stream_metric_windows
from searchpulse.streaming.consolidate import stream_consolidate
from searchpulse.streaming.land import land_stream, landed_events, landed_rejects, message_files


def run(stream, path):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-cp").outputMode("append")
    writer.trigger(availableNow=True).start(path).awaitTermination()


def test_landing_is_incremental_and_exactly_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def add(first, bad):
        lines = [json.dumps({"event_id": i, "timestamp": f"2024-01-0{1 + i % 2}T05:00:00Z", "query": f"q{i}"}) for i in range(first, first + 10)]
        spark.createDataFrame([(x,) for x in lines + bad], "value string").coalesce(1).write.mode("append").text(src)

    def go():
        stream = spark.readStream.text(src)
        land_stream(stream, out, f"{out}-cp", available_now=True, partition_time=F.col("timestamp")).awaitTermination()

    add(0, ["{oops"])
    go()
    assert landed_events(spark, out).count() == 10
    add(10, ["nope", json.dumps({"event_id": 99, "timestamp": "soon"})])
    go()
    go()
    events = landed_events(spark, out)
    assert sorted(r.event_id for r in events.collect()) == list(range(20))
    assert sorted({(r.day, r.hour) for r in events.select(F.lpad(F.col("day").cast("string"), 2, "0").alias("day"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour")).collect()}) == [("01", "05"), ("02", "05")]
    assert sorted(r.reject_reason for r in landed_rejects(spark, out).collect()) == ["bad timestamp", "unreadable record", "unreadable record"]
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "outcome" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_landing_defaults_to_arrival_time(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([('{"event_id": 1, "timestamp": "2001-01-01T00:00:00Z"}',)], "value string").write.text(src)
    land_stream(message_files(spark, src, 1000), out, f"{out}-cp", available_now=True).awaitTermination()
    assert int(landed_events(spark, out).head().year) >= 2024


@pytest.fixture
def log_batches():
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    events = []
    for i in range(900):
        at = t0 + timedelta(hours=i * 0.2 + rng.random())
        user = None if i % 50 == 0 else f"u{rng.randint(1, 9)}"
        results = None if i % 40 == 0 else rng.randint(0, 9)
        events.append((i, at, user, "s", "hot" if i % 3 == 0 else f"q{rng.randint(1, 5)}", results, rng.random() < 0.5, f"src{i % 4}"))
    return [events[k : k + 300] for k in range(0, 900, 300)]


def test_stream_equals_batch_over_several_loads(spark, tmp_path, log_batches):
    src, out = str(tmp_path / "src"), str(tmp_path / "daily")
    for batch in log_batches:
        spark.createDataFrame(batch, SEARCH_EVENT).coalesce(1).write.mode("append").parquet(src)
        run(stream_consolidate(spark.readStream.schema(SEARCH_EVENT).parquet(src), "2 hours"), out)
    whole = consolidate(spark.read.schema(SEARCH_EVENT).parquet(src))
    got = spark.read.parquet(out)
    last = max(b[1] for batch in log_batches for b in batch)
    closed = whole.where(F.timestamp_add("DAY", F.lit(1), F.col("date").cast("timestamp")) <= F.lit(last - timedelta(hours=2)))

    def comparable(df):
        return sorted(map(str, rows(df.select(*[F.round(c, 9).alias(c) if "avg" in c or "rate" in c else c for c in got.columns]))))

    assert got.count() > 20 and comparable(got) == comparable(closed)


def test_stream_alarms_equal_batch_alarms(spark, tmp_path):
    rng = random.Random(11)
    t0 = datetime(2024, 1, 1)
    rules = [AlarmRule("requests", 3, 2), AlarmRule("errors_5xx", 2, 3)]
    src, out = str(tmp_path / "src"), str(tmp_path / "alarms")
    schema = "ts timestamp, service string, latency_ms double, status int, bytes int"
    minute = 0.0
    last = t0
    for _ in range(3):
        batch = []
        for _ in range(250):
            minute += rng.choice([0.5, 1, 2, 2, 30 if rng.random() < 0.1 else 1])
            last = t0 + timedelta(minutes=minute)
            batch.append((last, rng.choice("ab"), 1.0, rng.choice([200, 500]), 1))
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        windows = stream_metric_windows(stream, "ts", 300, ["service"], metrics.request_stats(), "10 minutes")
        run(alarm_stream(windows, rules, ["service"], 300), out)
    batch_windows = metrics.metric_windows(spark.read.schema(schema).parquet(src), 300, ["service"], metrics.request_stats())
    want = metrics.alarm_transitions(batch_windows, rules, ["service"], 300)
    closed = want.where(F.col("changed_at") + 300 <= last.timestamp() - 600)
    got = spark.read.parquet(out)
    assert got.count() > 10
    assert sorted(rows(got.select("service", "metric", "state", "changed_at"))) == sorted(rows(closed.select("service", "metric", "state", "changed_at")))
