"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    rows, problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None, problem
    assert rows >= 0


def test_flagship(spark):
    got = entry.entry(spark).collect()
    assert len(got) == 100 and [r.c for r in got] == sorted((r.c for r in got), reverse=True)
