"""Every named query against its SQL twin on the smallest bundled data."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no bundled data")

# The fine log has no query-day of five searches here in the last week.
AT_SF001 = {"clustered_write", "daily_trends", "daily_true_top"}


@pytest.fixture(scope="module")
def duck():
    views = {}
    for sf_dir in (SF_DIR, "/root/testdata/sf0.01"):
        views[sf_dir] = con = duckdb.connect()
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return views


def by_column(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_same_rows_as_sql(spark, duck, name):
    sf_dir = "/root/testdata/sf0.01" if name in AT_SF001 else SF_DIR
    duck = duck[sf_dir]
    df = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    want = by_column([d[0] for d in cursor.description], cursor.fetchall())
    assert by_column(df.columns, [tuple(r) for r in df.collect()]) == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"date", "query", "rank", "count"} <= set(df.columns) and df.count() > 100


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
