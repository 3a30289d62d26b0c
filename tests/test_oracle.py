"""Every registered query against its checking SQL on a small scale factor."""

import os

import pytest

from tidewell.catalogue import ORACLE, QUERIES
from tools.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF_DIR, QUERIES[name], ORACLE.get(name)) == ""


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith(("pipeline", "op"))]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["segment", "total_price", "mean_balance", "orders", "max_price"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
