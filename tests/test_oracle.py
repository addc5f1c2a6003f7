"""Differential check: every registered query against its DuckDB SQL on the
smallest test tables (row count, column names, order-insensitive values)."""

import pytest

import __spark_entry__ as E
from compare import compare, duck
from conftest import SF_SMALL
from souk.plans import catalog, oracle

SQL = oracle.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(E.queries()[name](spark, SF_SMALL), con, SQL[name])
    assert r["ok"], r


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(SQL) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "level" in df.columns
