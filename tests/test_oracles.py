"""Registered queries run; those with SQL agree with it."""

import duckdb
import pytest
from check_oracles import connect, difference

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf) -> duckdb.DuckDBPyConnection:
    return connect(sf)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4


# Queries without SQL. The text operators have their own tests, the suites theirs in test_learning.
OTHERS = sorted(n for n in entry.queries() if n not in SQL and not n.startswith("op") and n != "pipeline" and not n.endswith("_suite"))


@pytest.mark.parametrize("name", OTHERS)
def test_runs_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got) > 0
    assert difference(got, con.execute(SQL[name]).df()) is None
