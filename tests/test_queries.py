"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, bag

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = oracle.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, rows) == bag(columns, cur.fetchall())


def test_late_stream_matches_batches(spark):
    late = entry.queries()["stream_late_rows"](spark, SF_DIR)
    assert all(r["sample_id"] % 97 == 0 for r in late.collect())
