from dataclasses import replace

import pytest
from support import rows
from pyspark.sql import functions as F

from searchpulse.config import TrendConfig
from searchpulse.operators.consolidate import canonical_log
from searchpulse.operators.datagen import HOT_QUERIES, TOPIC_QUERIES, generate_batch, generate_time_series
from searchpulse.plans.daily import Tables, run_daily
from searchpulse.schemas import RESULT_ROW, schema_differences

END = "2024-01-30 12:00:00"


def test_distribution(spark):
    log = generate_batch(spark, 40_000, END, seed=42).cache()
    n = log.count()
    hot = log.where(F.col("query").isin(HOT_QUERIES)).count() / n
    assert hot == pytest.approx(0.3 + 0.7 * 5 / 40, abs=0.01)
    with_results = log.where("results_count > 0")
    assert with_results.where("click_through").count() / with_results.count() == pytest.approx(0.7, abs=0.01)
    assert log.where("results_count = 0 and click_through").count() == 0
    low, high, users = rows(log.agg(F.min("results_count"), F.max("results_count"), F.count_distinct("user_id")))[0]
    assert (low, high) == (0, 500) and users > 9500
    assert log.select("query").distinct().count() == sum(map(len, TOPIC_QUERIES.values())) == 40
    spread = log.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).head()
    assert str(spread.a) >= "2024-01-30 11:00:00" and str(spread.b) <= "2024-01-30 12:00:00"


def test_repeatable_in_any_layout(spark):
    one = generate_batch(spark, 500, END, seed=1)
    ids = spark.range(500).repartition(7).orderBy(F.rand())
    from searchpulse.operators.datagen import generate_log

    assert sorted(rows(one)) == sorted(rows(generate_log(ids, END, seed=1)))
    assert sorted(rows(one)) != sorted(rows(generate_batch(spark, 500, END, seed=0)))


def test_series_hours(spark):
    log = generate_time_series(spark, hours=3, per_hour=100, end=END)
    per = log.groupBy(F.floor(F.col("event_id") / 100).alias("h")).agg(F.count("*"), F.max("timestamp").alias("last"))
    got = {h: (n, str(last)[:13]) for h, n, last in rows(per)}
    assert {n for n, _ in got.values()} == {100} and got[0][1] >= "2024-01-30 11" and got[2][1] <= "2024-01-30 10"


@pytest.fixture(scope="module")
def log(spark):
    two_days = generate_time_series(spark, hours=36, per_hour=200, end="2024-01-30 23:59:59")
    return canonical_log(two_days).cache()


def test_daily_run(spark, log, tmp_path):
    tables = Tables(str(tmp_path / "run"))
    cfg = TrendConfig(feature_partitions=4, with_growth=True)
    got = run_daily(log, tables, "2024-01-30", "2024-01-31 02:00:00", cfg)
    items = got.orderBy("rank").collect()
    assert schema_differences(got.select(RESULT_ROW.names).schema, RESULT_ROW) == []
    assert [r["rank"] for r in items] == list(range(1, len(items) + 1)) and 0 < len(items) <= 50
    assert {r.query for r in items} & set(HOT_QUERIES)
    assert any(r.growth_rate for r in items)
    per_cluster = got.groupBy("cluster_id").count().agg(F.max("count")).head()[0]
    assert per_cluster <= 5
    clustered = spark.read.parquet(tables.clustered)
    stats = spark.read.parquet(tables.cluster_stats)
    assert stats.agg(F.sum("cluster_size")).head()[0] == clustered.count()
    texts = spark.read.parquet(tables.cluster_texts)
    assert texts.agg(F.count("*")).head()[0] == clustered.count()

    before = sorted(rows(got.drop("ttl", "processed_at")))
    again = run_daily(log, tables, "2024-01-30", "2024-01-31 02:00:00", cfg)
    assert sorted(rows(again.drop("ttl", "processed_at"))) == before

    run_daily(log, tables, "2024-01-29", "2024-01-30 02:00:00", replace(cfg, with_growth=False), label_fn=lambda texts: "Custom ")
    stored = spark.read.parquet(tables.results)
    assert {str(r.date) for r in stored.select("date").distinct().collect()} == {"2024-01-29", "2024-01-30"}
    assert {r.category for r in stored.where("date = '2024-01-29'").collect()} == {"custom"}


def test_true_top_k_takes_all_rows(spark, log, tmp_path):
    cfg = TrendConfig(feature_partitions=4, per_cluster=None, top_n=12)
    got = run_daily(log, Tables(str(tmp_path / "run")), "2024-01-30", "2024-01-31 02:00:00", cfg)
    want = log.where(F.to_date("timestamp") == "2024-01-30").groupBy("query_text").count().orderBy(F.desc("count"), "query_text").limit(12)
    assert [r.query for r in got.orderBy("rank").collect()] == [r.query_text for r in want.collect()]


def test_empty_window_raises(log, tmp_path):
    with pytest.raises(ValueError):
        run_daily(log, Tables(str(tmp_path / "run")), "2025-06-01", "2025-06-02 02:00:00", TrendConfig(feature_partitions=4))


def test_history_and_late_rows_are_consolidated(spark, log, tmp_path):
    from searchpulse.operators.consolidate import consolidate
    from searchpulse.plans.daily import consolidate_stage

    def old(day, n):
        return log.limit(n).withColumn("timestamp", F.lit(f"{day} 10:00:00").cast(log.schema["timestamp"].dataType))

    tables = Tables(str(tmp_path / "run"))
    history = log.union(old("2023-12-01", 20)).union(old("2024-01-10", 5)).checkpoint()
    later = history.union(old("2023-12-01", 3)).union(old("2023-11-30", 2)).checkpoint()
    known = later.union(old("2024-01-10", 4)).checkpoint()
    undated = known.union(old("2024-01-10", 1).withColumn("timestamp", F.lit(None).cast(log.schema["timestamp"].dataType))).checkpoint()
    runs = [(history, None), (later, None), (known, old("2024-01-10", 4)), (undated, None)]
    for landed, new_rows in runs:
        consolidate_stage(landed, tables, "2024-01-30", TrendConfig(feature_partitions=4), new_rows)
        columns = ["date", "query_text", "query_count", "unique_users"]
        got = spark.read.parquet(tables.consolidated).select(columns)
        want = consolidate(landed).select(columns)
        assert sorted(rows(got), key=str) == sorted(rows(want), key=str)
