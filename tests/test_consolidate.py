from datetime import date, datetime

import pytest
from support import rows
from pyspark.sql import functions as F

from searchpulse.operators.consolidate import (
    canonical_log,
    consolidate,
    recent,
    recent_high_volume,
    recompute_touched_days,
    write_by_date,
)
from searchpulse.operators.growth import day_growth

LOG = "event_id long, timestamp timestamp, user_id string, query_text string, results_count int, click_through boolean, source string"


def at(day, hour=12, second=0):
    return datetime(2024, 1, day, hour, 0, second)


@pytest.fixture
def log(spark):
    return spark.createDataFrame(
        [
            (3, at(1, 10), "u1", "a", 10, True, "late"),
            (1, at(1, 9), "u1", "a", 20, False, "first"),
            (2, at(1, 9), "u2", "a", None, None, "second"),
            (4, at(1, 11), None, "a", 30, True, "other"),
            (5, at(2, 9), "u1", "a", 1, True, "x"),
            (6, at(1, 9), "u1", " A", 1, True, "x"),
            (7, at(1, 9), "u9", None, 4, False, "nulls"),
            (8, at(1, 9), "u9", None, 6, False, "nulls"),
        ],
        LOG,
    )


def test_aggregates_with_nulls(log):
    got = {(r.query_text, r.date): r for r in consolidate(log).collect()}
    a = got["a", date(2024, 1, 1)]
    assert (a.query_count, a.unique_users, a.avg_results_count, a.click_through_rate) == (4, 2, 20.0, 0.5)
    assert (a.source, a.year, a.month, a.day) == ("first", 2024, 1, 1)


def test_texts_are_grouped_as_they_are(log):
    keys = {(r.query_text, r.date.day, r.query_count) for r in consolidate(log).collect()}
    assert keys == {("a", 1, 4), ("a", 2, 1), (" A", 1, 1), (None, 1, 2)}


def test_source_does_not_depend_on_row_order(spark, log):
    for seed in range(3):
        shuffled = log.orderBy(F.rand(seed)).repartition(5)
        assert consolidate(shuffled).where("query_text = 'a' and day = 1").head().source == "first"


def test_canonical_prefers_query_text(spark):
    df = spark.createDataFrame([("t", "q"), (None, "q"), (None, None)], "query_text string, query string")
    assert [r.query_text for r in canonical_log(df).collect()] == ["t", "q", ""]
    only = spark.createDataFrame([("q",)], "query string")
    assert canonical_log(only).columns == ["query_text"]


def test_recent_excludes_the_seventh_day_back(spark):
    days = [(date(2024, 1, d), d) for d in (23, 24, 30, 31)]
    df = spark.createDataFrame(days, "date date, query_count long")
    assert [r.query_count for r in recent(df, "2024-01-30").orderBy("date").collect()] == [24, 30, 31]


def test_volume_floor_is_inclusive(spark):
    df = spark.createDataFrame([(date(2024, 1, 30), n) for n in (4, 5, 6)], "date date, query_count long")
    assert sorted(r.query_count for r in recent_high_volume(df, "2024-01-30").collect()) == [5, 6]


def test_plan_keeps_a_hot_query_spread(log):
    plan = consolidate(log)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "CartesianProduct" not in plan


def test_overwrite_replaces_only_given_dates(spark, log, tmp_path):
    path = str(tmp_path / "daily")
    write_by_date(consolidate(log), path)
    write_by_date(consolidate(log.where("event_id = 5")).withColumn("query_count", F.lit(99).cast("long")), path)
    got = {(r.query_text, str(r.date)): r.query_count for r in spark.read.parquet(path).collect()}
    assert got["a", "2024-01-02"] == 99 and got["a", "2024-01-01"] == 4
    pruned = spark.read.parquet(path).where("date = date'2024-01-02'")
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_static_overwrite_drops_other_dates(spark, log, tmp_path):
    path = str(tmp_path / "daily")
    write_by_date(consolidate(log), path)
    write_by_date(consolidate(log.where("event_id = 5")), path, replace_all=True)
    assert spark.read.parquet(path).count() == 1


def test_the_log_is_hashed_before_the_first_shuffle(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    plan = consolidate(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    deepest = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in deepest and "Sort" not in deepest


def test_late_rows_redo_their_days(spark, log, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    dated = log.withColumn("date", F.to_date("timestamp"))
    early, late = dated.where("event_id <> 5 and event_id <> 4"), dated.where("event_id in (4, 5)")
    early.write.partitionBy("date").parquet(raw)
    write_by_date(consolidate(early.drop("date")), out)
    late.write.mode("append").partitionBy("date").parquet(raw)
    recompute_touched_days(spark, raw, late, out)
    want = consolidate(log)
    assert sorted(map(str, rows(spark.read.parquet(out).select(want.columns)))) == sorted(map(str, rows(want)))


def test_growth_needs_the_day_before(spark):
    data = [("a", 1, 10), ("a", 2, 15), ("a", 4, 30), ("b", 2, 5), ("b", 3, 0), ("b", 4, 7)]
    df = spark.createDataFrame([(q, date(2024, 1, d), n) for q, d, n in data], "query_text string, date date, query_count long")
    got = {(r.query_text, r.date.day): r.growth_rate for r in day_growth(df).collect()}
    assert got == {("a", 1): None, ("a", 2): 0.5, ("a", 4): None, ("b", 2): None, ("b", 3): -1.0, ("b", 4): None}
    plan = day_growth(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
