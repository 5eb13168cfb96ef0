"""Point reads, pages, index reads and ad-hoc SQL over the results table."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchpulse.operators import quality, serve
from searchpulse.operators.consolidate import consolidate
from searchpulse.operators.index import lookup
from searchpulse.plans.batch_queries import result_table, served_index, served_results
from searchpulse.plans.registry import DAILY_SQL, RESULT_COLUMNS_SQL, RESULTS_SQL, query
from searchpulse.schemas import RESULT_ROW
from searchpulse.sources.fixtures import AS_OF, search_log

PAGE_COLUMNS = ["date", "query_id", "query", "rank", "count", "next_token"]


def _page_sql(after: str, n: int) -> str:
    where = f"date = DATE '{AS_OF}' AND query_id > '{after}'"
    return f"""
WITH page AS (SELECT *, row_number() OVER (ORDER BY query_id) AS rn, count(*) OVER () AS remaining
              FROM ({RESULTS_SQL}) WHERE {where})
SELECT date, query_id, query, rank, count,
       CASE WHEN remaining > {n} THEN base64(encode('{{"date":"{AS_OF}","query_id":"' || (SELECT max(query_id) FROM page WHERE rn <= {n}) || '"}}')) END AS next_token
FROM page WHERE rn <= {n}
"""


@query("trending_by_date", f"SELECT {RESULT_COLUMNS_SQL} FROM ({RESULTS_SQL}) WHERE date = DATE '2024-01-15'")
def trending_by_date(spark, sf_dir):
    return serve.by_date(served_results(spark, sf_dir), "2024-01-15")


@query("trending_latest", f"SELECT {RESULT_COLUMNS_SQL} FROM ({RESULTS_SQL}) WHERE date = (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) <= DATE '2024-02-10')")
def trending_latest(spark, sf_dir):
    return serve.latest(served_results(spark, sf_dir), "2024-02-10")


@query("page_first", _page_sql("", 10))
def page_first(spark, sf_dir):
    return serve.trending_page(served_results(spark, sf_dir), AS_OF, 10).select(*PAGE_COLUMNS)


FIRST_TOKEN_SQL = f"""
(SELECT max(query_id) FROM (SELECT query_id FROM ({RESULTS_SQL}) WHERE date = DATE '{AS_OF}' ORDER BY query_id LIMIT 10))
"""


@query("page_next", _page_sql("@", 15).replace("query_id > '@'", f"query_id > {FIRST_TOKEN_SQL}"))
def page_next(spark, sf_dir):
    """The page after ``page_first``, by the token that page returns."""
    rows = served_results(spark, sf_dir)
    token = serve.trending_page(rows, AS_OF, 10).select("next_token").head()[0]
    return serve.trending_page(rows, AS_OF, 15, token).select(*PAGE_COLUMNS)


@query("page_token", f"""
SELECT date, query_id, base64(encode('{{"date":"' || date || '","query_id":"' || query_id || '"}}')) AS token,
       CAST(date AS VARCHAR) AS token_date, query_id AS token_query_id
FROM ({RESULTS_SQL})
""")
def page_token(spark, sf_dir):
    rows = served_results(spark, sf_dir).select("date", "query_id", serve.next_token(F.col("date"), F.col("query_id")).alias("token"))
    key = serve.token_key(F.col("token"))
    return rows.withColumns({"token_date": key["date"], "token_query_id": key["query_id"]})


@query("by_category", f"SELECT {RESULT_COLUMNS_SQL} FROM ({RESULTS_SQL}) WHERE category = 'travel'")
def by_category(spark, sf_dir):
    """From the index: the files of other buckets are not opened."""
    return serve.by_category(lookup(spark, served_index(spark, sf_dir, "category"), RESULT_ROW, "category", "travel"), "travel")


@query("by_cluster", f"SELECT {RESULT_COLUMNS_SQL} FROM ({RESULTS_SQL}) WHERE cluster_id = 3")
def by_cluster(spark, sf_dir):
    return serve.by_cluster(lookup(spark, served_index(spark, sf_dir, "cluster_id"), RESULT_ROW, "cluster_id", 3), 3)


ITEM_SQL = """
'{"query":"' || query || '","rank":' || rank || ',"count":' || count || ',"growth_rate":0.0'
|| CASE WHEN category <> 'other' THEN ',"category":"' || category || '"' ELSE '' END
|| ',"cluster_id":' || cluster_id || '}'
"""


@query("page_document", f"""
SELECT '{{"date":"{AS_OF}","trending_queries":[' || string_agg({ITEM_SQL}, ',' ORDER BY rank) || '],"next_token":"' ||
       base64(encode('{{"date":"{AS_OF}","query_id":"' || max(query_id) || '"}}')) || '"}}' AS document
FROM ({RESULTS_SQL}) WHERE date = DATE '{AS_OF}' AND rank <= 20
""")
def page_document(spark, sf_dir):
    rows = served_results(spark, sf_dir).withColumn("category", F.nullif(F.col("category"), F.lit("other")))
    return serve.page_document(rows, AS_OF, 20)


@query("format_page", f"SELECT date, query, rank, {ITEM_SQL} AS item FROM ({RESULTS_SQL})")
def format_page(spark, sf_dir):
    """Rows without a category leave it out of the JSON item."""
    rows = served_results(spark, sf_dir).withColumn("category", F.nullif(F.col("category"), F.lit("other")))
    return serve.format_items(rows).select("date", "query", "rank", "item")


ADHOC = """
SELECT source, date, count(*) AS queries, CAST(sum(query_count) AS BIGINT) AS searches, max(query_count) AS busiest
FROM {daily} GROUP BY source, date HAVING count(*) > 1
"""


@query("adhoc_sql", ADHOC.format(daily=f"({DAILY_SQL})"))
def adhoc_sql(spark, sf_dir):
    serve.register_tables(spark, {"consolidated_queries": consolidate(search_log(spark, sf_dir))})
    return serve.adhoc_sql(spark, ADHOC.format(daily="consolidated_queries"))


@query("check_rank_order", f"""
SELECT date, query, rank, coalesce(lag(rank) OVER (PARTITION BY date ORDER BY query) <= rank, true) AS in_order FROM ({RESULTS_SQL})
""")
def check_rank_order(spark, sf_dir):
    """Rank order along the alphabet: both outcomes occur."""
    return quality.rank_order(result_table(spark, sf_dir), order="query").select("date", "query", "rank", "in_order")


@query("check_required", f"""
SELECT 'required_fields' AS validation, count(*) FILTER (category = 'other') = 0 AS success,
       'date: 0, query: 0, rank: 0, count: 0, category: ' || count(*) FILTER (category = 'other') AS details
FROM ({RESULTS_SQL})
""")
def check_required(spark, sf_dir):
    rows = result_table(spark, sf_dir).withColumn("category", F.nullif(F.col("category"), F.lit("other")))
    return quality.check_required(rows, ["date", "query", "rank", "count", "category"])


@query("check_results", f"""
SELECT 'has_data' AS validation, count(*) > 0 AS success, 'rows: ' || count(*) AS details FROM ({RESULTS_SQL})
UNION ALL SELECT 'required_fields', count(*) FILTER (query IS NULL OR rank IS NULL OR count IS NULL) = 0, 'query: 0, rank: 0, count: 0' FROM ({RESULTS_SQL})
UNION ALL SELECT 'rank_order', true, 'out of order: ' || count(*) FILTER (before > rank)
FROM (SELECT rank, lag(rank) OVER (PARTITION BY date ORDER BY query_id) AS before FROM ({RESULTS_SQL}))
""")
def check_results(spark, sf_dir):
    rows = result_table(spark, sf_dir)
    return quality.run_suite(
        [
            quality.check_has_data(rows),
            quality.check_required(rows, ["query", "rank", "count"]),
            quality.check_rank_order(rows),
        ]
    )


@query("freshness", f"""
SELECT 'result_freshness' AS validation, DATE '2024-02-05' - max(CAST(ts AS DATE)) <= 7 AS success,
       'age days: ' || (DATE '2024-02-05' - max(CAST(ts AS DATE))) AS details FROM events
UNION ALL
SELECT 'event_freshness', age <= 24 * 3600, 'age hours: ' || CAST(floor(age / 3600) AS BIGINT)
FROM (SELECT epoch(TIMESTAMP '2024-02-05 00:00:00') - floor(epoch(max(ts))) AS age FROM events)
""")
def freshness(spark, sf_dir):
    log = search_log(spark, sf_dir)
    days = log.select(F.to_date("timestamp").alias("date"))
    return quality.run_suite(
        [quality.check_result_freshness(days, "2024-02-05"), quality.check_event_freshness(log, "2024-02-05 00:00:00")]
    )
