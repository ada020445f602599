"""Every query with SQL must equal it on the smallest tables."""

import pytest

from conftest import SMALL
from tools.check import compare, connect
from watchloom.plans import load_all

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert "incident_id" in df.columns and df.count() > 0
