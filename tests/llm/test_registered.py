"""Registered queries against their checking SQL, on whole tables."""

from __future__ import annotations

import pytest

from embergrid.llm.catalog import ORACLE, QUERIES
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_checking_sql(spark, sf_dir, name):
    connection = connect(sf_dir)
    assert assert_same(QUERIES[name](spark, sf_dir), connection, ORACLE[name]) > 0


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
