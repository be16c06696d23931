"""Every registered query at the smallest scale, against its SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

DIR = "/root/testdata/sf0.001"
# too few rows at this scale for the query to find anything
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    said = compare(spark, con, DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert said is None or (said == "no rows on either side" and name in MAY_BE_EMPTY), said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
