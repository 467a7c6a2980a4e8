"""Registered queries against their SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from faultloom.plans import catalog, oracle
from oracle_check import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_same_as_sql(spark, con, name):
    problems = differences(catalog.QUERIES[name](spark, SF), con, oracle.SQL[name])
    assert [p for p in problems if p != "no rows"] == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "risk_level" in df.columns and df.count() > 0
