"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import database, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_sql_has_queries():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    found = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(found, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0
