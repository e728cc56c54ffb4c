"""Every registered query equals its DuckDB oracle (rows, columns, values)."""

import pytest

from poslake.plans.catalog import oracle_sql, queries
from poslake.testing import compare_with_oracle, duckdb_connection

QUERIES = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_dir, con, name):
    ok, detail = compare_with_oracle(spark, sf_dir, QUERIES[name], SQL[name], con)
    assert ok, detail


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "account_id" in df.columns
