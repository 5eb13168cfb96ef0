import base64
import json
from datetime import date

import pytest
from support import rows

from searchpulse.schemas import RESULT_ROW
from searchpulse.operators import rank, serve

DAY = date(2024, 1, 30)


@pytest.fixture(scope="module")
def results(spark):
    data = [(f"q{i:03}", d, 1000 - i, i % 4, ["news", "travel"][i % 2]) for d in (DAY, date(2024, 1, 28)) for i in range(45)]
    df = spark.createDataFrame(data, "query_text string, date date, query_count long, cluster_id int, category string")
    return rank.result_rows(rank.rank_trends(df), "2024-01-31 02:00:00").cache()


@pytest.mark.parametrize("bad", ["0", "101", "abc", "", "1.5", -3])
def test_limits_are_checked(bad):
    with pytest.raises(ValueError):
        serve.parse_limit(bad)


@pytest.mark.parametrize("given,want", [(None, 50), ("1", 1), (100, 100)])
def test_limits_accepted(given, want):
    assert serve.parse_limit(given) == want


@pytest.mark.parametrize("bad", [None, "", "05-01-2025", "2025-13-01", "today"])
def test_dates_are_checked(bad):
    with pytest.raises(ValueError):
        serve.parse_date(bad)


def test_unpadded_date_is_accepted(results):
    assert serve.parse_date("2025-1-5") == "2025-1-5"


@pytest.mark.parametrize("bad", ["%%%", base64.b64encode(b"nope").decode(), base64.b64encode(b'{"date": "x"}').decode()])
def test_broken_tokens(bad):
    with pytest.raises(ValueError):
        serve.parse_token(bad)


@pytest.mark.parametrize("limit", [7, 15, 44, 45, 100])
def test_pages_cover_the_date_once(results, limit):
    seen, token, pages = [], None, 0
    while True:
        page = serve.trending_page(results, "2024-01-30", limit, token).collect()
        ranks = [r["rank"] for r in page]
        assert ranks == sorted(ranks) and len(page) <= limit
        seen += ranks
        tokens = {r.next_token for r in page}
        assert len(tokens) == 1
        token, pages = tokens.pop(), pages + 1
        if token is None:
            break
    assert seen == list(range(1, 46)) and pages == -(-45 // limit)


def test_token_is_base64_json_of_the_key(results):
    page = serve.trending_page(results, "2024-01-30", 3).collect()
    key = json.loads(base64.b64decode(page[0].next_token))
    assert key == {"date": "2024-01-30", "query_id": page[-1].query_id}


def test_empty_date_is_an_empty_page(results):
    assert serve.trending_page(results, "2020-01-01").count() == 0


def test_page_plan_is_a_bounded_sort(results):
    plan = serve.trending_page(results, "2024-01-30", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=6" in plan


def test_latest_day(results):
    def newest(as_of):
        return {str(r.date) for r in serve.latest(results, as_of).collect()}

    assert newest("2024-01-30") == {"2024-01-30"} and newest("2024-01-29") == {"2024-01-28"} and newest("2024-01-01") == set()


def test_index_reads(results):
    travel = serve.by_category(results, "travel").collect()
    assert travel and [r["rank"] for r in travel] == sorted(r["rank"] for r in travel)
    up = [r["count"] for r in serve.by_cluster(results, 3).collect()]
    down = [r["count"] for r in serve.by_cluster(results, 3, descending=True).collect()]
    assert up == sorted(up) and down == sorted(down, reverse=True)


def test_items_leave_out_null_fields(spark):
    df = spark.createDataFrame(
        [(DAY, "text", "name", 2, 9, None, "news", None), (DAY, None, None, None, None, 0.5, None, 4)],
        "date date, query_text string, query string, rank int, count long, growth_rate double, category string, cluster_id int",
    )
    items = [json.loads(r.item) for r in serve.format_items(df).collect()]
    assert items == [
        {"query": "text", "rank": 2, "count": 9, "category": "news"},
        {"query": "", "rank": 0, "count": 0, "growth_rate": 0.5, "cluster_id": 4},
    ]


def test_adhoc_sql_keeps_its_result(spark, results, tmp_path):
    serve.register_tables(spark, {"trend_results": results})
    out = serve.adhoc_sql(spark, "select date, count(*) as n from trend_results group by date", str(tmp_path / "r"))
    assert sorted(rows(out)) == [(date(2024, 1, 28), 45), (DAY, 45)]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_a_token_of_another_date_is_refused(spark):
    import base64

    token = base64.b64encode(b'{"date":"2024-01-02","query_id":"x"}').decode()
    rows = spark.createDataFrame([], RESULT_ROW)
    with pytest.raises(ValueError, match="2024-01-02"):
        serve.trending_page(rows, "2024-01-30", 10, token)


def test_a_page_reads_one_partition(spark, results, tmp_path):
    path = str(tmp_path / "results")
    rank.store_results(results, path)
    page = serve.trending_page(spark.read.schema(RESULT_ROW).parquet(path), "2024-01-30", 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "hashpartitioning" not in plan


def test_an_unpadded_date_matches_nothing(results):
    assert serve.trending_page(results, "2024-01-30", 10).count() == 10
    assert serve.trending_page(results, "2024-1-30", 10).count() == 0
