"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import harness
from tests.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = harness.QUERIES, harness.ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, rows, state, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert state in ("ok", "rows only"), state
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
