"""Comparison of a Spark result with the checking database's result."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    plain = [tuple(_plain(row[index]) for index in order) for row in rows]
    return sorted(plain, key=repr)


def assert_same(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> int:
    expected = connection.execute(sql)
    expected_columns = [item[0] for item in expected.description]
    assert sorted(result.columns) == sorted(expected_columns)
    left = _rows(result.columns, result.collect())
    right = _rows(expected_columns, expected.fetchall())
    assert len(left) == len(right)
    for one, other in zip(left, right, strict=True):
        assert one == other, (sorted(result.columns), one, other)
        assert [type(value) for value in one] == [type(value) for value in other]
    return len(left)
