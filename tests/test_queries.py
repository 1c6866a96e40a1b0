"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)) or ["none"])
def test_query_without_sql_runs(spark, sf_dir, name):
    if name != "none":
        assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry(spark).count() > 0
