"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions and filters read as values.

    A plain projection is merged into its readers, which repeats a costly expression, such as a
    document parse, for each use. A one-row generator is not, and stays in generated code.
    """
    items = [column.alias(name) for name, column in columns.items()]
    rest = [name for name in df.columns if name not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*items))))
