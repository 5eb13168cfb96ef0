"""Latency, cost and compression reports, metric windows, alarms, check summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from searchpulse.functions import keys
from searchpulse.operators import metrics, quality, reports, retention
from searchpulse.operators.datagen import generate_log, generate_series
from searchpulse.operators.datagen import HOT_QUERIES, TOPIC_QUERIES
from searchpulse.operators.metrics import AlarmRule
from searchpulse.operators.percentiles import medians, percentile_floor
from searchpulse.plans.batch_queries import result_table
from searchpulse.plans.registry import REQUESTS_SQL, RESULTS_SQL, query
from searchpulse.schemas import RESULT_ROW
from searchpulse.sources.fixtures import arrivals, costs, object_keys, requests, table

HOUR = 3600
FIXTURE_RULES = [
    AlarmRule("requests", 5, 2),
    AlarmRule("errors_5xx", 3, 2),
    AlarmRule("latency_max_ms", 60, 3),
    AlarmRule("latency_avg_ms", 50, 1),
]


def floor_percentile_sql(p: int, values: str = "vals") -> str:
    return f"{values}[CAST(least((len({values}) * {p}) // 100 + 1, len({values})) AS INTEGER)]"


VALUES_SQL = f"SELECT service, list_sort(list(latency_ms)) AS vals FROM ({REQUESTS_SQL}) GROUP BY service"
MEDIAN_SQL = "(vals[(len(vals) - 1) // 2 + 1] + vals[len(vals) // 2 + 1]) / 2"


@query("percentile_floor", f"SELECT service, {floor_percentile_sql(50)} AS p50, {floor_percentile_sql(95)} AS p95, {floor_percentile_sql(99)} AS p99 FROM ({VALUES_SQL})")
def percentile_floor_query(spark, sf_dir):
    return percentile_floor(requests(spark, sf_dir), ["service"], "latency_ms", [50, 95, 99])


@query("median_variants", f"SELECT service, {MEDIAN_SQL} AS median, vals[len(vals) // 2 + 1] AS upper_median FROM ({VALUES_SQL})")
def median_variants(spark, sf_dir):
    return medians(requests(spark, sf_dir), ["service"], "latency_ms")


@query("latency_report", f"""
SELECT day, total_requests, successful, errors, duration_seconds, actual_rps, success_rate, avg_latency_ms,
       {MEDIAN_SQL} AS median_latency_ms, {floor_percentile_sql(95)} AS p95_latency_ms,
       {floor_percentile_sql(99)} AS p99_latency_ms, vals[1] AS min_latency_ms, vals[len(vals)] AS max_latency_ms,
       CAST(10 AS DOUBLE) AS target_rps, status_codes
FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) AS total_requests, count(*) FILTER (status < 400) AS successful,
         count(*) FILTER (status >= 400) AS errors,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS duration_seconds,
         round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 9) AS actual_rps,
         count(*) FILTER (status < 400) / count(*) AS success_rate,
         round(avg(latency_ms) FILTER (status < 400), 9) AS avg_latency_ms,
         concat_ws(',', CASE WHEN count(*) FILTER (status = 200) > 0 THEN '200:' || count(*) FILTER (status = 200) END,
                        CASE WHEN count(*) FILTER (status = 500) > 0 THEN '500:' || count(*) FILTER (status = 500) END) AS status_codes,
         list_sort(list(latency_ms) FILTER (status < 400)) AS vals
  FROM ({REQUESTS_SQL}) GROUP BY CAST(ts AS DATE))
""")
def latency_report(spark, sf_dir):
    log = requests(spark, sf_dir).withColumn("day", F.to_date("ts"))
    report = reports.latency_report(log, ["day"], target_rps=10)
    codes = F.transform(F.array_sort(F.map_entries("status_codes")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    rounded = {c: F.round(c, 9) for c in ("actual_rps", "avg_latency_ms")}
    return report.withColumns({**rounded, "status_codes": F.array_join(codes, ",")})


@query("status_distribution", f"SELECT service, CAST(status AS INTEGER) AS status, count(*) AS requests FROM ({REQUESTS_SQL}) GROUP BY service, status")
def status_distribution(spark, sf_dir):
    return reports.status_distribution(requests(spark, sf_dir), ["service"])


@query("cost_by_service", """
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'total' ELSE o_orderpriority END AS service,
       round(sum(o_totalprice), 2) AS cost
FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-08-02' - 7 AND CAST(o_orderdate AS DATE) < DATE '2001-08-02'
GROUP BY ROLLUP (o_orderpriority)
""")
def cost_by_service(spark, sf_dir):
    return reports.cost_by_service(costs(spark, sf_dir), "2001-08-02")


@query("compression_summary", """
SELECT count(*) FILTER (event_type <> 'error') AS files_processed, count(*) FILTER (event_type = 'error') AS files_failed,
       CAST(sum(event_id * 3 + 100) FILTER (event_type <> 'error') AS BIGINT) AS total_original_size,
       CAST(sum(event_id + length(props)) FILTER (event_type <> 'error') AS BIGINT) AS total_compressed_size,
       round(1 - sum(event_id + length(props)) FILTER (event_type <> 'error')
                 / sum(event_id * 3 + 100) FILTER (event_type <> 'error'), 9) AS compression_ratio
FROM events
""")
def compression_summary(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(
        (F.col("event_type") != "error").alias("success"),
        (F.col("event_id") * 3 + 100).alias("original_size"),
        (F.col("event_id") + F.length("props")).alias("compressed_size"),
    )
    summary = reports.compression_summary(files).drop("compression_percent")
    return summary.withColumn("compression_ratio", F.round("compression_ratio", 9))


WINDOWS_SQL = """
SELECT CAST(floor(epoch_us(ts) / ({s} * 1000000.0)) AS BIGINT) * {s} AS window_start, service,
       count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes,
       count(*) FILTER (status >= 400 AND status < 500) AS errors_4xx, count(*) FILTER (status >= 500) AS errors_5xx,
       round(avg(latency_ms), 9) AS latency_avg_ms, max(latency_ms) AS latency_max_ms,
       quantile_disc(latency_ms, 0.99) AS latency_p99_ms
FROM (""" + REQUESTS_SQL + """) GROUP BY 1, 2
"""


def hourly(spark, sf_dir):
    return metrics.request_windows(requests(spark, sf_dir), HOUR, ["service"])


def ruled(spark, sf_dir):
    """Hourly windows with the series that the rules name, no others."""
    return metrics.windows_for_rules(requests(spark, sf_dir), HOUR, ["service"], FIXTURE_RULES, metrics.request_stats())


@query("metric_windows", WINDOWS_SQL.format(s=300))
def metric_windows(spark, sf_dir):
    windows = metrics.request_windows(requests(spark, sf_dir), 300, ["service"])
    return windows.withColumn("latency_avg_ms", F.round("latency_avg_ms", 9))


@query("metric_windows_hourly", WINDOWS_SQL.format(s=HOUR))
def metric_windows_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("latency_avg_ms", F.round("latency_avg_ms", 9))


@query("run_windows", f"""
SELECT CAST(floor(epoch_us(ts) / {HOUR * 1000000.0}) AS BIGINT) * {HOUR} AS window_start, count(*) AS runs_started,
       count(*) FILTER (event_type = 'view') AS runs_succeeded, count(*) FILTER (event_type = 'error') AS runs_failed,
       count(*) FILTER (event_type = 'signup') AS runs_timed_out,
       round(avg(value), 9) AS duration_avg_ms, max(value) AS duration_max_ms
FROM events GROUP BY 1
""")
def run_windows(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for x in ("view", "succeeded", "error", "failed", "signup", "timed_out")])
    runs = table(spark, sf_dir, "events").select(
        "ts", F.element_at(status, F.col("event_type")).alias("status"), F.col("value").alias("duration_ms")
    )
    windows = metrics.metric_windows(runs, HOUR, [], metrics.run_stats())
    return windows.withColumn("duration_avg_ms", F.round("duration_avg_ms", 9))


@query("lag_windows", """
SELECT CAST(floor(epoch_us(arrival_time) / 300000000.0) AS BIGINT) * 300 AS window_start, service,
       max((epoch_us(arrival_time) - epoch_us(ts)) // 1000) AS max_lag_ms
FROM (SELECT ts, ts + to_seconds(event_id % 600) AS arrival_time, event_type AS service FROM events)
GROUP BY 1, 2
""")
def lag_windows(spark, sf_dir):
    return metrics.lag_windows(arrivals(spark, sf_dir), 300, ["service"])


def _state_sql(rule: AlarmRule) -> str:
    """State from an explicit series without gaps, unlike the range frame on the Spark side."""
    return f"""
CASE WHEN sum(CASE WHEN {rule.metric} >= {rule.threshold} THEN 1 ELSE 0 END)
     OVER (PARTITION BY service ORDER BY window_start ROWS BETWEEN {rule.periods - 1} PRECEDING AND CURRENT ROW) = {rule.periods}
     THEN 'ALARM' ELSE 'OK' END AS {rule.metric}_state"""


FILLED_SQL = f"""
SELECT s.service, s.window_start, w.requests, w.errors_5xx, w.latency_max_ms, w.latency_avg_ms
FROM (SELECT service, unnest(range(lo, hi + 5 * {HOUR}, {HOUR})) AS window_start
      FROM (SELECT service, min(window_start) AS lo, max(window_start) AS hi FROM ({WINDOWS_SQL.format(s=HOUR)}) GROUP BY service)) s
LEFT JOIN ({WINDOWS_SQL.format(s=HOUR)}) w USING (service, window_start)
"""
STATES_SQL = f"SELECT service, window_start, requests, {', '.join(_state_sql(r) for r in FIXTURE_RULES)} FROM ({FILLED_SQL})"


@query("alarm_batch", f"""
SELECT service, window_start, {', '.join(r.metric + '_state' for r in FIXTURE_RULES)}
FROM ({STATES_SQL}) WHERE requests IS NOT NULL
""")
def alarm_batch(spark, sf_dir):
    states = metrics.alarm_states(ruled(spark, sf_dir), FIXTURE_RULES, ["service"], HOUR)
    return states.select("service", "window_start", *[f"{r.metric}_state" for r in FIXTURE_RULES])


TRANSITIONS_SQL = f"""
SELECT service, metric, state, changed_at FROM (
  SELECT service, metric, state, window_start AS changed_at,
         lag(state, 1, 'OK') OVER (PARTITION BY service, metric ORDER BY window_start) AS before
  FROM ({' UNION ALL '.join(f"SELECT service, window_start, '{r.metric}' AS metric, {r.metric}_state AS state FROM ({STATES_SQL})" for r in FIXTURE_RULES)}))
WHERE state <> before
"""


@query("alarm_transitions", TRANSITIONS_SQL)
def alarm_transitions(spark, sf_dir):
    return metrics.alarm_transitions(ruled(spark, sf_dir), FIXTURE_RULES, ["service"], HOUR)


# The month folded to one day, so that windows of five minutes hold enough for the default alarms: each series as SQL over a window's events.
FOLDED_SQL = "SELECT CAST(floor(epoch(ts)) AS BIGINT) % 86400 // 300 * 300 AS window_start, event_type, value, event_id FROM events"
ALARM_SERIES_SQL = {
    "runs_failed": "count(*) FILTER (event_type = 'error')",
    "runs_timed_out": "count(*) FILTER (event_type = 'signup')",
    "requests_5xx": "count(*) FILTER (event_type = 'error')",
    "requests_4xx": "count(*) FILTER (event_type = 'signup')",
    "latency_p99_ms": "quantile_disc(value * 20, 0.99)",
    "function_errors": "count(*) FILTER (event_type = 'error')",
    "function_throttles": "count(*) FILTER (event_type = 'signup')",
    "table_user_errors": "count(*) FILTER (event_type = 'click')",
    "table_system_errors": "count(*) FILTER (event_type = 'purchase' AND value >= 20)",
}


def _default_alarm_sql(rule: AlarmRule) -> str:
    return f"""
SELECT '{rule.metric}' AS metric, window_start AS changed_at, state FROM (
  SELECT window_start, state, lag(state, 1, 'OK') OVER (ORDER BY window_start) AS before FROM (
    SELECT window_start, CASE WHEN sum(CASE WHEN v >= {rule.threshold} THEN 1 ELSE 0 END)
             OVER (ORDER BY window_start ROWS BETWEEN {rule.periods - 1} PRECEDING AND CURRENT ROW) = {rule.periods} THEN 'ALARM' ELSE 'OK' END AS state
    FROM (SELECT unnest(range(0, 86400 + 3000, 300)) AS window_start)
    LEFT JOIN (SELECT window_start, {ALARM_SERIES_SQL[rule.metric]} AS v FROM ({FOLDED_SQL}) GROUP BY 1) USING (window_start)))
WHERE state <> before"""


@query("default_alarms", " UNION ALL ".join(_default_alarm_sql(r) for r in metrics.DEFAULT_ALARMS))
def default_alarms(spark, sf_dir):
    """All nine default alarms on series of runs, requests, functions and the results table."""
    at = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 86_400)
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(at.alias("ts"), "event_type", "value")

    def named(*pairs):
        return F.element_at(F.create_map(*[F.lit(x) for x in pairs]), kind)

    bad_task = F.when((kind != "purchase") | (F.col("value") >= 20), named("click", "user_error", "purchase", "system_error", "view", "completed"))
    status = F.coalesce(named("error", 500, "signup", 404), F.lit(200))
    requests_named = {
        "requests_5xx": F.count_if(F.col("status") >= 500),
        "requests_4xx": F.count_if((F.col("status") >= 400) & (F.col("status") < 500)),
    }
    sources = [
        (events.select("ts", named("view", "succeeded", "error", "failed", "signup", "timed_out").alias("status"), F.col("value").alias("duration_ms")), metrics.run_stats()),
        (events.select("ts", status.alias("status"), (F.col("value") * 20).alias("latency_ms")), {**requests_named, "latency_p99_ms": None}),
        (events.select("ts", named("error", "error", "signup", "throttled").alias("status"), F.col("value").alias("duration_ms")), metrics.function_stats()),
        (events.select("ts", bad_task.alias("status"), F.lit(1).alias("read_units"), F.lit(1).alias("write_units")), metrics.table_stats()),
    ]
    found = []
    for df, stats in sources:
        rules = [r for r in metrics.DEFAULT_ALARMS if r.metric in stats]
        kept = {name: c for name, c in stats.items() if c is not None}
        windows = metrics.windows_for_rules(df, metrics.ALARM_PERIOD_SECONDS, [], rules, kept)
        found.append(metrics.alarm_transitions(windows, rules, [], metrics.ALARM_PERIOD_SECONDS))
    return reduce(lambda a, b: a.unionByName(b), found).select("metric", "changed_at", "state")


KEY_SQL = """
SELECT event_id, ['raw-data/', 'logs/', 'images/', 'compressed/'][CAST(event_id % 4 AS INTEGER) + 1]
       || strftime(ts, 'year=%Y/month=%m/day=%d/') || 'part-' || event_id
       || ['.json', '.LOG', '.png', '.gz', '.csv'][CAST(event_id % 5 AS INTEGER) + 1] AS key
FROM events
"""


@query("log_file_filter", f"""
SELECT event_id, key FROM ({KEY_SQL})
WHERE (regexp_matches(lower(key), '\\.(log|json|txt|csv)$') OR contains(lower(key), 'logs/')
       OR contains(lower(key), 'raw-data/') OR contains(lower(key), 'search-queries/'))
  AND NOT (ends_with(key, '.gz') OR starts_with(key, 'compressed/'))
""")
def log_file_filter(spark, sf_dir):
    return object_keys(spark, sf_dir).where(keys.needs_compression(F.col("key"))).select("event_id", "key")


@query("compressed_key", f"""
SELECT event_id, key, 'compressed/' || regexp_extract(key, '(year=.*)$', 1) || '.gz' AS compressed_key,
       CASE WHEN ends_with(key, '.gz') THEN key ELSE key || '.gz' END AS plain_key
FROM ({KEY_SQL})
""")
def compressed_key(spark, sf_dir):
    return object_keys(spark, sf_dir).select(
        "event_id",
        "key",
        keys.compressed_key(F.col("key")).alias("compressed_key"),
        keys.compressed_key(F.col("key"), prefix="").alias("plain_key"),
    )


@query("purge_prefix_preview", f"""
SELECT count(*) AS to_delete, CAST(sum(length(props)) AS BIGINT) AS bytes
FROM ({KEY_SQL}) k JOIN events e ON e.event_id = k.event_id WHERE starts_with(key, 'logs/')
""")
def purge_prefix_preview(spark, sf_dir):
    return retention.purge_prefix_preview(object_keys(spark, sf_dir).withColumnRenamed("size", "length"), "logs/")


@query("check_summary", f"""
SELECT count(*) FILTER (requests < 5) AS passed, count(*) FILTER (requests >= 5) AS failed, count(*) AS total,
       bool_and(requests < 5) AS all_passed, CAST(sum(requests) AS BIGINT) AS total_duration
FROM ({WINDOWS_SQL.format(s=HOUR)})
""")
def check_summary(spark, sf_dir):
    checks = hourly(spark, sf_dir).select(
        F.concat_ws(" ", "service", "window_start").alias("validation"),
        (F.col("requests") < 5).alias("success"),
        F.concat(F.lit("requests: "), F.col("requests")).alias("details"),
        F.col("requests").alias("duration"),
    )
    return quality.check_summary(checks)


@query("quality_suite", f"""
SELECT 'has_data' AS validation, count(*) > 0 AS success, 'rows: ' || count(*) AS details FROM ({RESULTS_SQL})
UNION ALL SELECT 'required_fields', count(*) FILTER (date IS NULL OR query IS NULL OR rank IS NULL OR count IS NULL) = 0,
  'date: ' || count(*) FILTER (date IS NULL) || ', query: ' || count(*) FILTER (query IS NULL)
  || ', rank: ' || count(*) FILTER (rank IS NULL) || ', count: ' || count(*) FILTER (count IS NULL) FROM ({RESULTS_SQL})
UNION ALL SELECT 'item_fields', count(DISTINCT date) FILTER (query IS NULL OR rank IS NULL OR count IS NULL) = 0,
  'dates with errors: ' || count(DISTINCT date) FILTER (query IS NULL OR rank IS NULL OR count IS NULL) FROM ({RESULTS_SQL})
UNION ALL SELECT 'rank_order', count(*) FILTER (before > rank) = 0, 'out of order: ' || count(*) FILTER (before > rank)
  FROM (SELECT rank, lag(rank) OVER (PARTITION BY date ORDER BY query_id) AS before FROM ({RESULTS_SQL}))
UNION ALL SELECT 'schema', true, 'differences: none'
UNION ALL SELECT 'result_freshness', DATE '2024-02-01' - max(date) <= 7, 'age days: ' || (DATE '2024-02-01' - max(date)) FROM ({RESULTS_SQL})
UNION ALL SELECT 'event_freshness', age <= 86400, 'age hours: ' || CAST(floor(age / 3600) AS BIGINT)
FROM (SELECT epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts))) AS age FROM events)
""")
def quality_suite(spark, sf_dir):
    from searchpulse.operators.rank import nest_results

    rows = result_table(spark, sf_dir)
    return quality.run_suite(
        [
            quality.check_has_data(rows),
            quality.check_required(rows, ["date", "query", "rank", "count"]),
            quality.check_nested_items(nest_results(rows)),
            quality.check_rank_order(rows),
            quality.check_schema(spark, rows, RESULT_ROW),
            quality.check_result_freshness(rows, "2024-02-01"),
            quality.check_event_freshness(table(spark, sf_dir, "events"), "2024-02-01 00:00:00", ts="ts"),
        ]
    )


GEN_END = "2024-02-01 00:00:00"


def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def _draw_sql(which: str, slot: int, bound: int) -> str:
    return f"CAST(('0x' || substr(md5('42:{which}:' || event_id), {slot * 8 + 1}, 8))::BIGINT % {bound} AS INTEGER)"


GEN_SQL = f"""
SELECT event_id, {_draw_sql('b', 3, 3601)} AS seconds_back,
       'user_' || ({_draw_sql('a', 0, 10000)} + 1) AS user_id, 'session_' || ({_draw_sql('a', 1, 50000)} + 1) AS session_id,
       CASE WHEN {_draw_sql('a', 2, 1000)} < 300 THEN {_sql_list(HOT_QUERIES)}[{_draw_sql('a', 3, 5)} + 1]
            ELSE {_sql_list([q for qs in TOPIC_QUERIES.values() for q in qs])}[{_draw_sql('b', 0, 40)} + 1] END AS query,
       {_draw_sql('b', 1, 501)} AS results_count,
       {_draw_sql('b', 1, 501)} > 0 AND {_draw_sql('b', 2, 1000)} < 700 AS click_through
FROM events
"""


@query("gen_log", f"SELECT event_id, CAST(epoch(TIMESTAMP '{GEN_END}') AS BIGINT) - seconds_back AS seconds, user_id, session_id, query, results_count, click_through FROM ({GEN_SQL})")
def gen_log(spark, sf_dir):
    """One generated event per row of the event table."""
    ids = table(spark, sf_dir, "events").select("event_id")
    log = generate_log(ids, GEN_END, id_col="event_id")
    return log.withColumn("seconds", F.unix_timestamp("timestamp")).drop("timestamp", "source")


@query("gen_series", f"""
SELECT CAST(event_id // 500 AS INTEGER) AS hours_back, count(*) AS events,
       count(*) FILTER (query = 'python programming') AS hot_events,
       max(CAST(epoch(TIMESTAMP '{GEN_END}') AS BIGINT) - 3600 * (event_id // 500) - seconds_back) AS last_second
FROM ({GEN_SQL}) GROUP BY 1
""")
def gen_series(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select("event_id")
    log = generate_series(ids, GEN_END, 500, id_col="event_id")
    return log.groupBy(F.floor(F.col("event_id") / 500).cast("int").alias("hours_back")).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("query") == "python programming").alias("hot_events"),
        F.max(F.unix_timestamp("timestamp")).alias("last_second"),
    )
