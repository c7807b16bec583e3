"""Every registered query against its SQL at the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = connect(sf)
    c.execute("SET TimeZone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    ok, message, _ = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
