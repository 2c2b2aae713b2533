"""Every registered query next to its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from rollcall import suite

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [name for name in QUERIES if name in suite.QUERIES]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert compare(df, duck, SQL[name]) in (None, "empty")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
