"""Named queries over the bundled tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; the session runs in UTC."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# SQL twins of the fixture adapters.
LOG_SQL = """
SELECT event_id, ts, 'user_' || user_id AS user_id,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       'query ' || json_extract_string(props, '$.k') AS query_text,
       value AS results_count, event_type IN ('click', 'purchase') AS click_through,
       event_type AS source
FROM events
"""

DAILY_SQL = f"""
SELECT query_text, CAST(ts AS DATE) AS date, min(k) AS k, count(*) AS query_count,
       count(DISTINCT user_id) AS unique_users, avg(results_count) AS avg_results_count,
       avg(CASE WHEN click_through THEN 1 ELSE 0 END) AS click_through_rate,
       arg_min(source, (ts, event_id)) AS source
FROM ({LOG_SQL}) GROUP BY query_text, CAST(ts AS DATE)
"""

LABEL_CASE_SQL = """
['education', 'entertainment', 'technology', 'shopping', 'health',
 'news', 'travel', 'finance', 'sports', 'other'][CAST(k % 10 AS INTEGER) + 1]
"""

RESULTS_SQL = f"""
SELECT date, lpad(CAST(rank AS VARCHAR), 6, '0') || '#' || substr(sha256(query), 1, 12) AS query_id,
       query, CAST(rank AS INTEGER) AS rank, count, unique_users, category, cluster_id,
       click_through_rate, CAST(0 AS DOUBLE) AS growth_rate,
       CAST(epoch(CAST(date + 1 AS TIMESTAMP)) AS BIGINT) + 7200 + 30 * 86400 AS ttl,
       strftime(date + 1, '%Y-%m-%d') || 'T02:00:00' AS processed_at
FROM (
  SELECT date, query_text AS query,
         row_number() OVER (PARTITION BY date ORDER BY query_count DESC, query_text) AS rank,
         query_count AS count, unique_users, {LABEL_CASE_SQL} AS category,
         CAST(k % 10 AS INTEGER) AS cluster_id,
         CAST(round(click_through_rate, 3) AS DOUBLE) AS click_through_rate
  FROM ({DAILY_SQL})
) WHERE rank <= 50
"""
RESULT_COLUMNS_SQL = (
    "date, query_id, query, rank, count, unique_users, category, cluster_id, click_through_rate, growth_rate, ttl, processed_at"
)

REQUESTS_SQL = """
SELECT event_id, ts, event_type AS service, value AS latency_ms,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, length(props) AS bytes
FROM events
"""
