import random
from datetime import datetime, timedelta

import pytest
from support import rows
from pyspark.sql import functions as F

from searchpulse.operators import metrics
from searchpulse.operators.metrics import DEFAULT_ALARMS, AlarmRule

START = 1_704_067_200
PERIOD = 300


def series(spark, values):
    """values: window number -> metric value; absent numbers have no data."""
    return spark.createDataFrame(
        [("svc", START + i * PERIOD, float(v)) for i, v in values.items()], "service string, window_start long, errors double"
    )


def changes(spark, values, rule):
    got = metrics.alarm_transitions(series(spark, values), [rule], ["service"], PERIOD)
    return sorted(((r.changed_at - START) // PERIOD, r.state) for r in got.collect())


def brute_force(values, rule, upto):
    out, state = [], "OK"
    for i in range(upto):
        recent = [values.get(j, 0) >= rule.threshold and j in values for j in range(i - rule.periods + 1, i + 1)]
        new = "ALARM" if all(recent) else "OK"
        if new != state:
            out.append((i, new))
        state = new
    return sorted(out)


def test_exactly_m_breaches(spark):
    rule = AlarmRule("errors", 10, 3)
    assert changes(spark, {0: 10, 1: 11, 2: 12}, rule) == [(2, "ALARM"), (3, "OK")]


def test_one_breach_too_few(spark):
    assert changes(spark, {0: 10, 1: 11, 2: 9, 3: 10, 4: 10}, AlarmRule("errors", 10, 3)) == []


def test_a_missing_window_interrupts(spark):
    rule = AlarmRule("errors", 10, 2)
    assert changes(spark, {0: 10, 2: 10}, rule) == []
    assert changes(spark, {0: 10, 1: 10, 3: 10, 4: 10}, rule) == [(1, "ALARM"), (2, "OK"), (4, "ALARM"), (5, "OK")]


@pytest.mark.parametrize("periods", [1, 2, 3])
def test_random_series_match_brute_force(spark, periods):
    rng = random.Random(periods)
    values = {i: rng.choice([0, 0, 10, 10, 10]) for i in range(200) if rng.random() < 0.85}
    rule = AlarmRule("errors", 10, periods)
    assert changes(spark, values, rule) == brute_force(values, rule, 205)
    states = metrics.alarm_states(series(spark, values), [rule], ["service"], PERIOD)
    for r in states.collect():
        i = (r.window_start - START) // PERIOD
        alarmed = all(j in values and values[j] >= 10 for j in range(i - periods + 1, i + 1))
        assert r.errors_state == ("ALARM" if alarmed else "OK")


def test_default_rules():
    some = {("requests_5xx", 10, 2), ("requests_4xx", 50, 2), ("latency_p99_ms", 3000, 3), ("runs_failed", 1, 1)}
    assert some <= {(r.metric, r.threshold, r.periods) for r in DEFAULT_ALARMS} and len(DEFAULT_ALARMS) == 9


def test_windows_and_stats(spark):
    t = datetime(2024, 1, 1)
    data = [(t + timedelta(seconds=s), "a", float(s), st, 10) for s, st in [(0, 200), (299, 404), (300, 500), (599, 200)]]
    df = spark.createDataFrame(data, "ts timestamp, service string, latency_ms double, status int, bytes int")
    got = metrics.request_windows(df, 300, ["service"]).orderBy("window_start").collect()
    assert [(r.window_start - START, r.requests, r.bytes, r.errors_4xx, r.errors_5xx) for r in got] == [(0, 2, 20, 1, 0), (300, 2, 20, 0, 1)]
    assert [(r.latency_avg_ms, r.latency_max_ms, r.latency_p99_ms) for r in got] == [(149.5, 299.0, 299.0), (449.5, 599.0, 599.0)]


def test_other_stat_sets(spark):
    t = datetime(2024, 1, 1)
    runs = spark.createDataFrame([(t, "succeeded", 10.0), (t, "failed", 30.0)], "ts timestamp, status string, duration_ms double")
    r = metrics.metric_windows(runs, 3600, [], metrics.run_stats()).head()
    assert (r.runs_started, r.runs_succeeded, r.runs_failed, r.runs_timed_out, r.duration_avg_ms) == (2, 1, 1, 0, 20.0)
    calls = spark.createDataFrame([(t, "f", "error", 1.0), (t, "f", "throttled", 3.0)], "ts timestamp, name string, status string, duration_ms double")
    r = metrics.metric_windows(calls, 300, ["name"], metrics.function_stats()).head()
    assert (r.function_invocations, r.function_errors, r.function_throttles, r.duration_avg_ms) == (2, 1, 1, 2.0)
    ops = spark.createDataFrame([(t, "completed", 2, 3), (t, "user_error", 1, 0)], "ts timestamp, status string, read_units int, write_units int")
    r = metrics.metric_windows(ops, 300, [], metrics.table_stats()).head()
    assert (r.read_units, r.write_units, r.table_user_errors, r.tasks_completed) == (3, 3, 1, 1)


def test_lag_is_the_largest_delay(spark):
    t = datetime(2024, 1, 1)
    data = [(t, t + timedelta(milliseconds=1500), "a"), (t, t + timedelta(seconds=2), "a")]
    df = spark.createDataFrame(data, "event_time timestamp, arrival_time timestamp, service string")
    assert metrics.lag_windows(df, 300, ["service"]).head().max_lag_ms == 2000


def test_rules_need_no_join(spark):
    df = series(spark, {0: 1})
    plan = metrics.alarm_transitions(df, [AlarmRule("errors", 1, 1)], ["service"], PERIOD)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    assert rows(plan.select(F.col("state")).orderBy("state")) == [("ALARM",), ("OK",)]


def test_p99_is_exact_beyond_ten_thousand_rows(spark):
    df = spark.range(50_000).select(
        F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("a").alias("service"), F.lit(200).alias("status"),
        F.lit(1).alias("bytes"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("latency_ms"),
    )
    values = sorted(r[0] for r in df.select("latency_ms").collect())
    assert metrics.request_windows(df, 300, ["service"]).head().latency_p99_ms == values[49_500 - 1]
