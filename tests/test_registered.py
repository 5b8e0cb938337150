"""Every registered query against its SQL, over whole tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from symloom.plans.queries import registered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", registered())
def test_query_equals_its_sql(spark, connection, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert difference(frame, connection.sql(entry.oracle_sql()[name])) is None


def test_every_query_has_sql():
    assert set(registered()) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
