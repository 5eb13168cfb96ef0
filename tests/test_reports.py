import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from support import rows
from pyspark.sql import functions as F

from searchpulse.operators import reports
from searchpulse.operators.percentiles import medians, percentile_floor


def floor_index(values, p):
    ordered = sorted(values)
    return ordered[min(int(len(ordered) * p / 100), len(ordered) - 1)]


def groups():
    rng = random.Random(7)
    return {
        "uniform": [rng.random() * 500 for _ in range(800)],
        "ties": [float(rng.randint(0, 3)) for _ in range(500)],
        "outlier": [rng.random() for _ in range(300)] + [1e12, -1e12],
        "close": [1000 + i * 1e-6 for i in range(400)],
        "negative": [-rng.expovariate(1) for _ in range(99)],
        "one": [42.0],
        "two": [3.0, 1.0],
        None: [5.0, 6.0, 7.0],
    }


@pytest.fixture(scope="module")
def values(spark):
    data = [(g, v) for g, vs in groups().items() for v in vs] + [("one", None)]
    return spark.createDataFrame(data, "g string, v double").repartition(6)


def test_floor_percentiles_match_brute_force(values):
    got = {r.g: (r.p0, r.p50, r.p95, r.p99, r.p100) for r in percentile_floor(values, ["g"], "v", [0, 50, 95, 99, 100]).collect()}
    assert got == {g: tuple(floor_index(vs, p) for p in (0, 50, 95, 99, 100)) for g, vs in groups().items()}


def test_both_medians(values):
    got = {r.g: (r.median, r.upper_median) for r in medians(values, ["g"], "v").collect()}
    want = {g: (statistics.median(vs), sorted(vs)[len(vs) // 2]) for g, vs in groups().items()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=0)


def test_p95_of_the_first_600_numbers(spark):
    df = spark.range(600).select(F.lit("x").alias("g"), F.col("id").alias("v"))
    assert percentile_floor(df, ["g"], "v", [95]).head().p95 == 570


def test_latency_report(spark):
    start = datetime(2024, 1, 1)
    lat = [float(x) for x in range(100)]
    data = [("s", start + timedelta(seconds=i), v, 200) for i, v in enumerate(lat)]
    data += [("s", start + timedelta(seconds=100), 9999.0, 500), ("bad", start, 1.0, 503)]
    df = spark.createDataFrame(data, "service string, ts timestamp, latency_ms double, status int")
    got = {r.service: r for r in reports.latency_report(df, ["service"], target_rps=5).collect()}
    s = got["s"]
    assert (s.total_requests, s.successful, s.errors, s.duration_seconds) == (101, 100, 1, 100.0)
    assert (s.actual_rps, s.target_rps, s.success_rate) == (1.01, 5.0, 100 / 101)
    assert (s.avg_latency_ms, s.median_latency_ms, s.p95_latency_ms, s.p99_latency_ms) == (49.5, 49.5, 95.0, 99.0)
    assert (s.min_latency_ms, s.max_latency_ms) == (0.0, 99.0)
    bad = got["bad"]
    assert (bad.total_requests, bad.successful, bad.p95_latency_ms, bad.avg_latency_ms, bad.actual_rps) == (1, 0, 0.0, 0.0, 0.0)


def test_status_map(spark):
    df = spark.createDataFrame([("a", 200), ("a", 200), ("a", 404)], "g string, status int")
    assert reports.status_map(df, ["g"]).head().status_codes == {200: 2, 404: 1}


def test_costs_use_a_half_open_range(spark):
    data = [(date(2024, 1, d), s, a) for d, s, a in [(2, "x", 9.0), (3, "x", 1.005), (9, "y", 2.0), (10, "y", 50.0), (5, None, 4.0)]]
    df = spark.createDataFrame(data, "date date, service string, amount double")
    got = rows(reports.cost_by_service(df, "2024-01-10"))
    assert got[0][0] == "total" and got[0][1] == pytest.approx(7.0, abs=0.011)
    assert [s for s, _ in got[1:]] == [None, "y", "x"]


def test_compression_totals(spark):
    schema = "success boolean, original_size long, compressed_size long"
    df = spark.createDataFrame([(True, 100, 25), (True, 100, 50), (False, None, None)], schema)
    s = reports.compression_summary(df).head()
    assert (s.files_processed, s.files_failed, s.total_original_size, s.total_compressed_size) == (2, 1, 200, 75)
    assert (s.compression_ratio, s.compression_percent) == (0.625, "62.50%")
    empty = reports.compression_summary(df.where("false")).head()
    assert (empty.files_processed, empty.total_original_size, empty.compression_ratio) == (0, 0, 0.0)
    points = reports.compression_metrics(reports.compression_summary(df), F.current_timestamp()).collect()
    assert {p.name: (p.value, p.unit) for p in points}["CompressionRatio"] == (62.5, "Percent") and len(points) == 5


def test_percentiles_shuffle_buckets_only(spark, values, tmp_path):
    path = str(tmp_path / "v")
    values.write.parquet(path)
    got = percentile_floor(spark.read.parquet(path), ["g"], "v", [50, 99])
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in final and "SortMergeJoin" not in final


@pytest.mark.parametrize("scale", [1e-6, 1e-3, 0.0, 1e12])
def test_percentiles_of_any_magnitude(spark, scale):
    """Tiny, constant and huge values."""
    data = [(float(i * 7919 % 1000) * scale,) for i in range(1000)]
    df = spark.createDataFrame(data, "v double").withColumn("g", F.lit(1))
    r = percentile_floor(df, ["g"], "v", [50, 99]).head()
    want = sorted(d[0] for d in data)
    assert (r.p50, r.p99) == (want[500], want[990])
