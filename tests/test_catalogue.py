"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from columnscope.plans import catalogue
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
CATALOGUE = catalogue()
SQL = {name: sql for name, (_, sql) in CATALOGUE.items() if sql is not None}
QUERIES = {name: query for name, (query, _) in CATALOGUE.items()}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
