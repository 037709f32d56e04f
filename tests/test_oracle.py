"""Every query that SQL can say against DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert len(QUERIES[name](spark, sf).collect()) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and df.columns[0] == "client"
