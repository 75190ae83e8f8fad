"""Every registered query of the reference's operators against its SQL, at the smallest size; and the entry contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.plans import event_queries, language_queries

QUERIES = event_queries.queries() | language_queries.queries()
SQL = event_queries.oracle_sql() | language_queries.oracle_sql()

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("events", "orders", "nation"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def rows(values):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in values), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = sql.sql(f"select {', '.join(names)} from ({SQL[name]})")
    assert sorted(sql.sql(SQL[name]).columns) == names
    got = rows(df.select(*names).collect())
    assert got == rows(want.fetchall()) and got


def test_entry_has_rows_and_every_oracle_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
