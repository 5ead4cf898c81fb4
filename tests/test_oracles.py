"""Every query that SQL can express gives the rows of the SQL; the others run."""

import pytest

import __spark_entry__ as entry
from conftest import assert_same
from threadloom.plans import core_queries, skew_queries

QUERIES = core_queries.QUERIES | skew_queries.QUERIES
SQL = core_queries.SQL | skew_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
