"""Index copies, purges and expiry of stored tables, changed types, and sketches that merge."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from support import rows, scan_metrics

from searchpulse.operators import quantiles, retention, users
from searchpulse.operators.index import bucket_of, lookup, refresh_index
from searchpulse.operators.rank import store_results
from searchpulse.schemas import RESULT_ROW
from searchpulse.sources import ingest


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def contents(files):
    return {f: open(f, "rb").read() for f in files}


# index


def results(spark, days, categories, per_day=20):
    data = []
    for d in days:
        for r in range(1, per_day + 1):
            category = categories[(r + d.day) % len(categories)]
            data.append((d, f"{r:06d}#x", f"q{r}", r, 100 - r, 5, category, r % 7, 0.5, 0.0, 1, "t"))
    return spark.createDataFrame(data, RESULT_ROW)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "results")
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(70)]
    store_results(results(spark, days, ["travel", "news", None, "sports"]), path)
    return path


def test_lookup_equals_a_filter_and_opens_one_bucket(spark, stored, tmp_path):
    table = spark.read.schema(RESULT_ROW).parquet(stored)
    for column, values in (("category", ["travel", "news", "nothing"]), ("cluster_id", [0, 3, 99])):
        index = str(tmp_path / column)
        refresh_index(table, index, column)
        for value in values:
            found = lookup(spark, index, RESULT_ROW, column, value)
            got, files = scan_metrics(found, "numFiles")
            assert sorted(map(tuple, got)) == sorted(rows(table.where(F.col(column) == value).select(*RESULT_ROW.names)))
            assert max(files) <= 3 < len(files_below(index)) / 10  # one for each of three months
    plan = lookup(spark, str(tmp_path / "category"), RESULT_ROW, "category", "travel")._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(category,travel)" in plan


def test_row_groups_of_other_values_are_skipped(spark, tmp_path):
    """Two values that share a bucket: the groups of one are not read for the other."""
    names = [f"c{i}" for i in range(200)]
    placed = spark.createDataFrame([(n,) for n in names], "c string").select("c", bucket_of(F.col("c")).alias("b")).collect()
    one = placed[0].b
    same = [r.c for r in placed if r.b == one]
    text = F.concat(*[F.sha2(F.concat(F.lit(str(k)), F.col("id").cast("string")), 512) for k in range(4)])
    big = spark.range(12_000).select(
        F.lit(date(2024, 1, 1)).alias("date"), F.col("id").cast("string").alias("query_id"), text.alias("query"),
        F.col("id").cast("int").alias("rank"), F.col("id").alias("count"), F.lit(1).cast("long").alias("unique_users"),
        F.element_at(F.array(*map(F.lit, same)), (F.col("id") % len(same) + 1).cast("int")).alias("category"),
        F.lit(1).alias("cluster_id"), F.lit(0.0).alias("click_through_rate"), F.lit(0.0).alias("growth_rate"), F.lit(1).cast("long").alias("ttl"), F.lit("t").alias("processed_at"),
    )
    index = str(tmp_path / "index")
    refresh_index(big, index, "category")
    got, read = scan_metrics(lookup(spark, index, RESULT_ROW, "category", same[3]), "numOutputRows")
    assert len(got) == len(range(3, 12_000, len(same))) and max(read) < 12_000 / 2


def test_refresh_leaves_no_trace_of_moved_rows(spark, stored, tmp_path):
    index, day = str(tmp_path / "index"), date(2024, 2, 10)
    table = lambda: spark.read.schema(RESULT_ROW).parquet(stored)
    refresh_index(table(), index, "category")
    kept = contents([f for f in files_below(index) if "2024-02" not in f])
    store_results(results(spark, [day], ["health"], per_day=3), stored)
    refresh_index(table(), index, "category", spark.createDataFrame([(day,)], "date date"))
    for value in ("travel", "news", "sports", "health"):
        assert sorted(rows(lookup(spark, index, RESULT_ROW, "category", value))) == sorted(rows(table().where(F.col("category") == value).select(*RESULT_ROW.names)))
    assert contents([f for f in files_below(index) if "2024-02" not in f]) == kept
    refresh_index(table().where("false"), str(tmp_path / "none"), "category")


# purge


def test_purge_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "log")
    data = [(i, "test_data" if d in (2, 3) and (d == 3 or i % 2) else "real", date(2024, 1, d)) for d in range(1, 6) for i in range(20)]
    data += [(99, None, date(2024, 1, 2)), (98, "x test_data y", None), (97, "real", None)]
    df = spark.createDataFrame(data, "id int, source string, date date")
    df.repartition(3).write.partitionBy("date").parquet(path)
    untouched = contents([f for f in files_below(path) if not any(f"date={d}" in f for d in ("2024-01-02", "2024-01-03", "__HIVE"))])
    want = sorted(rows(retention.purge(df, "test_data")), key=str)
    touched = retention.purge_stored(spark, path, ["date"], "test_data")
    assert {(str(r.date), r.removed) for r in touched.collect()} == {("2024-01-02", 10), ("2024-01-03", 20), ("None", 1)}
    assert sorted(rows(spark.read.parquet(path).select(df.columns)), key=str) == want
    assert not os.path.exists(f"{path}/date=2024-01-03")
    after = contents(files_below(path))
    assert all(after[f] == data for f, data in untouched.items())
    assert retention.purge_stored(spark, path, ["date"], "test_data").count() == 0
    assert contents(files_below(path)) == after


# expiry


def test_expired_partitions_go_in_two_steps(spark, tmp_path):
    path, name = str(tmp_path / "daily"), "expiry_test"
    days = [(date(2024, 1, d), d) for d in range(1, 11)]
    spark.createDataFrame(days, "date date, n int").write.partitionBy("date").parquet(path)
    ingest.register_table(spark, name, path)
    dry = retention.expire_partitions(spark, name, path, "2024-01-10", 4)
    assert sorted((str(r.date), r.days_over) for r in dry.collect()) == [(f"2024-01-0{d}", 6 - d) for d in range(1, 7)]
    assert spark.table(name).count() == 10 and retention.sweep_expired(spark, name, path, "2024-02-10") == 0

    running = spark.table(name).where("n > 0 AND date > DATE '2000-01-01'")
    running._jdf.queryExecution().executedPlan()  # planned before
    retention.expire_partitions(spark, name, path, "2024-01-10", 4, dry_run=False)
    assert len(running.collect()) == 10  # its files are still there
    assert spark.table(name).agg(F.min("date")).head()[0] == date(2024, 1, 7)
    assert retention.expired_partitions(spark, name, "2024-01-10", 4).count() == 0
    assert retention.sweep_expired(spark, name, path, "2024-01-10") == 0  # within the grace
    spark.sql(f"ALTER TABLE {name} ADD PARTITION (date = DATE '2024-01-02') LOCATION '{path}/date=2024-01-02'")
    assert retention.sweep_expired(spark, name, path, "2024-01-11") == 5
    assert sorted(os.path.basename(os.path.dirname(f)) for f in files_below(path) if "/_expired" not in f) == ["date=2024-01-02", *(f"date=2024-01-{d:02d}" for d in range(7, 11))]
    assert spark.read.parquet(path).count() == 5  # the notes are no data
    assert retention.sweep_expired(spark, name, path, "2024-01-11") == 0
    spark.sql(f"drop table {name}")


# types


def test_wider_types():
    assert [ingest.wider(*p) for p in [("int", "bigint"), ("bigint", "double"), ("float", "int"), ("double", "string"), ("date", "timestamp"), ("boolean", "int"), ("int", "int"), ("float", "float")]] == [
        "bigint", "double", "double", "string", "timestamp", "string", "int", "float"]


def test_generations_of_types(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda df, d: df.withColumn("day", F.lit(d)).coalesce(1).write.mode("append").partitionBy("day").parquet(path)
    for d in (1, 2, 5):
        write(spark.createDataFrame([(d, 1.5)], "id int, w double"), d)
    write(spark.createDataFrame([(3_000_000_000, True)], "id long, flag boolean"), 3)
    write(spark.createDataFrame([("x9", 2)], "id string, w int"), 4)
    df, changed = ingest.discover_widened(spark, path)
    assert dict(df.dtypes) == {"id": "string", "w": "double", "day": "int", "flag": "boolean"}
    assert sorted(rows(df.select("day", "id", "w", "flag"))) == [(1, "1", 1.5, None), (2, "2", 1.5, None), (3, "3000000000", None, True), (4, "x9", 2.0, None), (5, "5", 1.5, None)]
    assert {c: sorted(t) for c, t in changed.items()} == {"id": ["bigint", "int", "string"], "w": ["double", "int"]}
    assert len(ingest.generations(spark, path)) == 3
    plain, none = ingest.discover_widened(spark, f"{path}/day=1")
    assert none == {} and rows(plain) == [(1, 1.5)]


# sketches


def test_users_over_days_and_queries(spark):
    rng, seen, data = random.Random(2), {}, []
    for i in range(4000):
        day, query, user = datetime(2024, 1, rng.randint(1, 9)), rng.choice("abc"), rng.choice([None] + [f"u{k}" for k in range(700)])
        data.append((day, query, user))
        if 2 <= day.day <= 6:
            seen.setdefault(query, set()).update({user} - {None})
    data.append((datetime(2024, 1, 3), None, "u1"))
    log = spark.createDataFrame(data, "timestamp timestamp, query_text string, user_id string")
    daily = users.user_sketches(log)
    merged = users.users_between(daily, "2024-01-02", "2024-01-06")
    got = {r.query_text: (r.days, r.n_users) for r in merged.collect()}
    assert got == {**{q: (5, len(s)) for q, s in seen.items()}, None: (1, 1)}
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "zz")], "query_text string, other_text string")
    shared = {(r.query_text, r.other_text): (r.both, r.either) for r in users.shared_users(merged, pairs).collect()}
    assert shared == {(x, y): (len(seen[x] & seen[y]), len(seen[x] | seen[y])) for x, y in (("a", "b"), ("b", "c"))}
    many = spark.range(60_000).select(F.lit(datetime(2024, 1, 1)).alias("timestamp"), F.lit("q").alias("query_text"), F.col("id").cast("string").alias("user_id"))
    estimate = users.users_between(users.user_sketches(many), "2024-01-01", "2024-01-01").head().n_users
    assert estimate != 60_000 and abs(estimate - 60_000) <= users.RELATIVE_ERROR * 60_000
    assert users.user_sketches(log.where("false")).count() == 0


def test_shared_users_exact_beyond_the_sketch(spark, tmp_path):
    # 6000 users search query 1, 5000 of them and 1500 others query 2: beyond EXACT, a sketch only estimates
    data = [(i, datetime(2024, 1, 1 + i % 3), u, '{"k": 1}', 1.0, "search") for i, u in enumerate(range(6000))]
    data += [(10_000 + i, datetime(2024, 1, 2), u, '{"k": 2}', 1.0, "search") for i, u in enumerate(range(1000, 7500))]
    data += [(20_000, datetime(2024, 1, 2), None, '{"k": 3}', 1.0, "search")]
    schema = "event_id long, ts timestamp, user_id long, props string, value double, event_type string"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "events.parquet"))
    from searchpulse.plans.batch_queries import shared_users_query

    got = {(r.query_text, r.other_text): (r.both, r.either) for r in shared_users_query(spark, str(tmp_path)).collect()}
    assert got == {("query 1", "query 2"): (5000, 7500), ("query 2", "query 3"): (0, 6500)}


def test_users_between_within_error_beyond_the_sketch(spark, tmp_path):
    # 20 queries of 5000 users over the seven days: the sketches estimate, with an error that grows with the whole count
    data = [(q * 10_000 + u, datetime(2024, 1, 24 + u % 7), q * 10_000 + u, f'{{"k": {q}}}', 1.0, "search") for q in range(20) for u in range(5000)]
    schema = "event_id long, ts timestamp, user_id long, props string, value double, event_type string"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "events.parquet"))
    from searchpulse.plans.batch_queries import users_between_query

    got = users_between_query(spark, str(tmp_path)).collect()
    assert len(got) == 20 and {(r.days, r.exact_users) for r in got} == {(7, 5000)} and all(r.within_error for r in got)


def test_merged_quantiles_stay_within_the_rank_error(spark):
    rng = random.Random(4)
    data = [(datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(86_400)), "hot" if i % 4 else "cold", rng.lognormvariate(3, 2)) for i in range(60_000)]
    data += [(datetime(2024, 1, 1, 5), "nulls", None)] * 3 + [(datetime(2024, 1, 1, 6), "few", float(v)) for v in (3, 1, 2)]
    df = spark.createDataFrame(data, "ts timestamp, service string, latency_ms double")
    short = quantiles.sketch_windows(df, 300, ["service"])
    hours = quantiles.roll_up(short, 3600, ["service"])
    days = quantiles.roll_up(hours, 86_400, ["service"])
    for q in (0.01, 0.5, 0.9, 0.99):
        got = {r.service: r.value for r in days.select("service", quantiles.quantile(q).alias("value")).collect()}
        for service in ("hot", "cold"):
            values = sorted(v for _, s, v in data if s == service)
            rank = sum(v <= got[service] for v in values) / len(values)
            assert abs(rank - q) <= quantiles.RANK_ERROR
        assert got["nulls"] is None
    few = days.where("service = 'few'").select("n_values", "least", "most", quantiles.quantile(0.5).alias("m")).head()
    assert tuple(few) == (3, 1.0, 3.0, 2.0)


@pytest.mark.parametrize(
    "times, days",
    [
        # no rows in the hours before the cut (an hour before the last row): the day before it is still closed
        ([datetime(2024, 1, 1, 10), datetime(2024, 1, 2, 0, 30), datetime(2024, 1, 2, 1, 40)], [1704067200]),
        # the cut is 0.6 s past midnight, which the SQL rounds to whole seconds: that day is not closed yet
        ([datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 23, 30), datetime(2024, 1, 2, 1, 0, 0, 600_000)], []),
    ],
)
def test_stream_sketches_close_the_days_of_the_sql(spark, tmp_path, times, days):
    import pandas as pd

    events = pd.DataFrame({
        "event_id": range(len(times)), "ts": times, "user_id": 1, "event_type": "search",
        "value": [float(i) for i in range(len(times))], "props": "{}",
    })
    events.to_parquet(tmp_path / "events.parquet", index=False, coerce_timestamps="us")
    from searchpulse.plans.stream_queries import stream_quantile_sketches

    got = stream_quantile_sketches(spark, str(tmp_path)).collect()
    assert sorted(r.window_start for r in got) == days and all(r.within_bound for r in got)
