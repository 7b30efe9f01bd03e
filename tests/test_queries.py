"""Every registered query against its checking SQL, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as spark_entry
from embergrid.plans.catalog import QUERIES
from tests.compare import assert_same, connect

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_checking_sql(spark, sf_dir, database, name):
    result = spark_entry.queries()[name](spark, sf_dir)
    rows = assert_same(result, database, spark_entry.oracle_sql()[name])
    assert rows > 0


def test_every_query_has_checking_sql():
    assert set(QUERIES) <= set(spark_entry.oracle_sql())


def test_entry_gives_rows(spark):
    assert spark_entry.entry(spark).count() > 0
