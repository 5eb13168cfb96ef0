from datetime import date, datetime

from support import rows

from searchpulse.operators import quality, retention
from searchpulse.schemas import CONSOLIDATED

AS_OF = "2024-01-30"


def verdict(df):
    r = df.head()
    return r.success, r.details


def test_presence_and_required(spark):
    df = spark.createDataFrame([("q", 1), (None, 2)], "query string, rank int")
    assert verdict(quality.check_has_data(df)) == (True, "rows: 2")
    assert verdict(quality.check_has_data(df.where("false"))) == (False, "rows: 0")
    assert verdict(quality.check_required(df, ["query", "rank"])) == (False, "query: 1, rank: 0")


def test_nested_items(spark):
    schema = "date date, trending_queries array<struct<query string, rank int, count long>>"
    day = date(2024, 1, 1)
    good = spark.createDataFrame([(day, [("a", 1, 5)]), (day, [])], schema)
    bad = spark.createDataFrame([(day, [("a", 1, 5), (None, 2, 3)]), (day, None)], schema)
    assert verdict(quality.check_nested_items(good))[0]
    assert verdict(quality.check_nested_items(bad)) == (False, "dates with errors: 2")


def test_rank_order_allows_equal_ranks(spark):
    day = date(2024, 1, 1)
    df = spark.createDataFrame([(day, "a", 1), (day, "b", 1), (day, "c", 2)], "date date, query_id string, rank int")
    assert verdict(quality.check_rank_order(df))[0]
    swapped = spark.createDataFrame([(day, "a", 2), (day, "b", 1)], "date date, query_id string, rank int")
    assert verdict(quality.check_rank_order(swapped)) == (False, "out of order: 1")


def test_result_freshness(spark):
    def check(*dates):
        return verdict(quality.check_result_freshness(spark.createDataFrame([(d,) for d in dates], "date string"), AS_OF))

    assert check("2024-01-23", "not a date") == (True, "age days: 7")
    assert check("2024-01-22") == (False, "age days: 8")
    assert check("nonsense") == (True, "no data yet")


def test_event_freshness(spark):
    def check(*times):
        df = spark.createDataFrame([(t,) for t in times], "timestamp timestamp")
        return verdict(quality.check_event_freshness(df, "2024-01-30 12:00:00"))

    assert check(datetime(2024, 1, 29, 12)) == (True, "age hours: 24")
    assert check(datetime(2024, 1, 29, 11, 59)) == (False, "age hours: 24")
    assert check() == (True, "no data yet")


def test_suite_and_summary(spark):
    df = spark.createDataFrame([("q", 1)], "query string, rank int")
    suite = quality.run_suite([quality.check_has_data(df), quality.check_required(df, ["rank"]), quality.check_schema(spark, df, CONSOLIDATED)])
    assert suite.columns == quality.CHECK_COLUMNS and suite.count() == 3
    s = quality.check_summary(suite).head()
    assert (s.passed, s.failed, s.total, s.all_passed) == (2, 1, 3, False)


def test_ttl_is_exclusive(spark):
    df = spark.createDataFrame([(1706616000,), (1706616001,)], "ttl long")
    assert rows(retention.visible(df, "2024-01-30 12:00:00")) == [(1706616001,)]


def test_retention_border(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, d), d) for d in (19, 20, 21, 30)], "date date, n int")
    assert sorted(r.n for r in retention.retained(df, AS_OF, 10).collect()) == [21, 30]
    assert sorted(rows(retention.expired_dates(df, AS_OF, 10))) == [(date(2024, 1, 19), 1), (date(2024, 1, 20), 0)]
    path = str(tmp_path / "t")
    df.write.partitionBy("date").parquet(path)
    plan = retention.retained(spark.read.parquet(path), AS_OF, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert retention.RETENTION_DAYS["raw"] == {"default": 90, "prod": 2555}


def test_purge_keeps_rows_without_source(spark):
    df = spark.createDataFrame([("x_sample_data_generator_1",), ("web",), (None,)], "source string")
    assert rows(retention.purge_preview(df, "sample_data_generator")) == [(1, 2)]
    assert [r.source for r in retention.purge(df, "sample_data_generator").collect()] == ["web", None]
