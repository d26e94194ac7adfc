"""Every query gives what its SQL gives."""

import pytest
from check_oracle import compare, database

import __spark_entry__ as e


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", list(e.oracle_sql()))
def test_query(spark, sf, con, name):
    found = e.queries()[name](spark, sf)
    assert compare(found, con.sql(e.oracle_sql()[name])) is None


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() > 0
