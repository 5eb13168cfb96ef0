from datetime import date

import pytest
from support import rows
from pyspark.sql import functions as F

from searchpulse.operators import label, rank
from searchpulse.schemas import RESULT_ROW, TREND_ITEM_FIELDS, schema_differences

DAY = date(2024, 1, 30)


def test_keyword_labels_ties_and_defaults(spark):
    texts = spark.createDataFrame(
        [(1, 1, "Buy cheap shoes"), (1, 2, "python api"), (2, 1, "zzz"), (3, 1, "python python movie")],
        "cluster_id int, position int, query_text string",
    )
    got = dict(rows(label.label_by_keywords(texts)))
    assert got == {1: "shopping", 2: "other", 3: "technology"}


def lists(spark):
    return spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "cluster_id int, texts array<string>")


def test_injected_labeller_is_called_per_cluster(spark):
    got = dict(rows(label.label_with(lists(spark), lambda texts: f"  {'+'.join(texts).upper()} ")))
    assert got == {1: "a+b", 2: "c"}


def test_failing_labeller_is_retried_then_uncategorized(spark, tmp_path):
    marks = str(tmp_path)

    def flaky(texts):
        import os
        import uuid

        mine = [f for f in os.listdir(marks) if f.startswith(texts[0])]
        open(os.path.join(marks, f"{texts[0]}-{uuid.uuid4()}"), "w").close()
        if texts[0] == "a" and len(mine) == 1:
            return "news"
        raise TimeoutError if texts[0] == "a" else ValueError("no")

    got = dict(rows(label.label_with(lists(spark), flaky, delay=0.01)))
    assert got == {1: "news", 2: "uncategorized"}


def test_prompt_layout(spark):
    text = lists(spark).where("cluster_id = 1").select(label.label_prompt(F.col("texts")).alias("p")).head().p
    assert "Search queries:\n- a\n- b\n\nRespond" in text and "finance, sports, other.\n" in text


def test_texts_per_cluster_are_limited_and_ordered(spark):
    df = spark.createDataFrame([(1, f"t{i:02}", i) for i in range(30)], "cluster_id int, query_text string, query_count long")
    got = label.text_lists(label.top_texts(df, 10)).head().texts
    assert got == [f"t{i:02}" for i in range(29, 19, -1)]


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_labels_attach_left(spark, monkeypatch, limit):
    """With the labels broadcast and joined by shuffle."""
    monkeypatch.setattr("searchpulse.functions.joins.counted_side.__defaults__", (limit,))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cluster_id int, query_text string")
    labels = spark.createDataFrame([(1, "news"), (2, None)], "cluster_id int, category string")
    got = {r.query_text: r.category for r in label.attach_labels(df, labels).collect()}
    assert got == {"a": "news", "b": "other", "c": "other"}


def test_replies_are_normalised_not_forced(spark):
    df = spark.createDataFrame([(" News ",), ("Cars",), (None,)], "category string")
    assert rows(label.normalise_labels(df)) == [("news", True), ("cars", False), ("other", True)]


def clustered(spark):
    data = [(f"q{i}", DAY, i % 5, 7, 0.0625, i % 3) for i in range(60)]
    return spark.createDataFrame(
        data, "query_text string, date date, query_count long, unique_users long, click_through_rate double, cluster_id int"
    )


def test_top_per_cluster_breaks_ties_by_text(spark):
    got = rows(rank.top_per_cluster(clustered(spark), 3).where("cluster_id = 0").orderBy("cluster_rank").select("query_text"))
    assert got == [("q24",), ("q39",), ("q54",)]
    plan = rank.top_per_cluster(clustered(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ranks_are_dense_and_capped(spark):
    for ranked in (rank.rank_trends(clustered(spark), 50), rank.rank_overall(clustered(spark), 50)):
        got = ranked.orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, 51))
        assert [r["count"] for r in got] == sorted((r["count"] for r in got), reverse=True)
        assert got[0].click_through_rate == 0.063 and got[0].growth_rate == 0.0
        assert got[0].category == "other"
    plan = rank.rank_overall(clustered(spark))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_missing_fields_take_defaults(spark):
    df = spark.createDataFrame([(None, DAY, 3, None)], "query_text string, date date, query_count long, cluster_id int")
    row = rank.rank_trends(df).head()
    assert (row.query, row["count"], row.unique_users, row.cluster_id, row.click_through_rate) == ("", 3, 0, 0, 0.0)


def test_result_rows_and_views(spark):
    stored = rank.result_rows(rank.rank_trends(clustered(spark)), "2024-01-31 02:00:00")
    assert schema_differences(stored.schema, RESULT_ROW) == []
    first = stored.orderBy("query_id").head()
    assert first["rank"] == 1 and first.ttl == 1706666400 + 30 * 86400 and first.processed_at == "2024-01-31T02:00:00"
    nested = rank.nest_results(stored)
    assert nested.head().query_count == 50 and [q["rank"] for q in nested.head().trending_queries] == list(range(1, 51))
    back = rank.explode_results(nested).select(stored.columns)
    assert sorted(rows(back)) == sorted(rows(stored))
    assert set(TREND_ITEM_FIELDS) <= set(stored.columns)


def test_reading_an_absent_date_is_empty(spark, tmp_path):
    path = str(tmp_path / "c")
    clustered(spark).write.partitionBy("date").parquet(path)
    assert rank.clustered_for_date(spark, path, "2024-01-30").count() == 60
    missing = rank.clustered_for_date(spark, path, "2023-01-01")
    assert missing.count() == 0
    assert "PartitionFilters: [isnotnull(date" in missing._jdf.queryExecution().sparkPlan().toString()


def test_unknown_growth_stays_unknown(spark):
    df = spark.createDataFrame([("a", DAY, 5, None), ("b", DAY, 4, 0.5)], "query_text string, date date, query_count long, growth_rate double")
    assert [r.growth_rate for r in rank.rank_trends(df).orderBy("rank").collect()] == [None, 0.5]
    assert rank.rank_trends(df.drop("growth_rate")).head().growth_rate == 0.0
