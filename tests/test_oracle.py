"""Every registered job equals its DuckDB statement on the smallest test data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tessera.oracle.harness import compare, duckdb_connection
from tessera.oracle.sql import ORACLE_SQL
from tessera.plans.registry import QUERIES

from .conftest import SMALL

KEYS = sorted(ORACLE_SQL)


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SMALL)
    result = compare(key, df, con, entry.oracle_sql()[key])
    assert result.ok, result.summary()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 63


@pytest.mark.parametrize("k", [7, 30])
def test_customer_360_small_limit_matches_oracle(spark, con, k):
    from tessera.plans import commerce
    from tessera.plans.registry import Run, report

    r = Run.get(spark, SMALL)
    df = commerce.customer_360(
        r.segments, r.pm, r.cm, r.patterns, r.cohorts, r.predictive, commerce.primary_products(r.tx), r.p.as_of, k
    )
    sql = entry.oracle_sql()["customer_360"].replace("LIMIT 10000", f"LIMIT {k}")
    result = compare("customer_360", report(df), con, sql)
    assert result.ok, result.summary()
