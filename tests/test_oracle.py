"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 70


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    if name in SQL:
        assert compare(spark, sf, name, QUERIES[name], SQL[name], con) is None
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
