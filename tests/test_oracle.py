"""Every query of the library that SQL can express equals DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from evalframe import queries
from tests.oracle import assert_same, connection

FOUND, SQL = queries.all_queries(), queries.all_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


def test_all_have_sql():
    assert sorted(FOUND) == sorted(SQL)
    assert len(FOUND) == 183


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, con, name):
    assert_same(spark, con, FOUND[name], SQL[name])
