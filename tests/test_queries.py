"""Every registered query with SQL must equal it on the driver tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .compare import compare, connect

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["symbol", "ts"]
    assert df.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, con):
    error, rows, _ = compare(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert not error
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_queries_return_rows(name, spark, sf_dir, con):
    error, rows, _ = compare(spark, con, QUERIES[name], None, sf_dir)
    assert not error and rows > 0
