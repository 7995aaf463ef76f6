"""Every registered query that has SQL on the smallest tables against it; the others have tests of their own."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    state, n, _, note = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert state == "match", note
    assert n > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "context"] and df.count() > 0
