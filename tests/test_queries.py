"""Every registered query with a SQL twin gives the same rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import SF_DIR, connect, difference

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
@pytest.mark.parametrize("name", [n for n in queries() if n in SQL])
def test_same_rows(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(queries())
