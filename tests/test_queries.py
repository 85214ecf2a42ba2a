import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from quillon.suite.oracles import oracle_sql
from quillon.suite.queries import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


def test_entry_points_register_every_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "row_id" and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(spark, duck, QUERIES[name], ORACLES[name], SF) is None
