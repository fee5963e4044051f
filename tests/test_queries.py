"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from crosstally.registry import QUERIES, SQL
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# At this scale these have no rows on either side.
MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok or (note == "0 rows" and name in MAY_BE_EMPTY), note


def test_entry(spark):
    assert entry.entry(spark).columns == ["flag", "side", "count"]


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
