"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, oracle_connection

import __spark_entry__ as entry_module

SF = "sf0.001"
QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    outcome, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert outcome.startswith("ok") or (name not in SQL and outcome.startswith("rows=")), outcome
