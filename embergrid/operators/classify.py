"""Classes: size steps by acreage, focus and outside by boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.functions.text import class_id
from embergrid.operators.skew import lookup_join


def step_class(number: Column, breaks: Sequence[tuple[float, int]]) -> Column:
    """Value of the highest break at or below the number; NULL and negatives count as 0."""
    size = F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0))
    (_, first), *higher = breaks
    result = F.lit(first)
    for minimum, value in higher:
        result = F.when(size >= minimum, value).otherwise(result)
    return result


def fire_size(acres: Column) -> Column:
    """Marker size of a fire."""
    return step_class(acres, fixed.FIRE_BREAKS)


def fire_class(acres: Column) -> Column:
    """Class id of a fire."""
    return class_id(fixed.FIRE_CLASS_PREFIX, fire_size(acres))


def with_kind(df: DataFrame, kind: Column | str) -> DataFrame:
    """Tags every row with a kind."""
    return df.withColumn("kind", F.lit(kind) if isinstance(kind, str) else kind)


def of_kind(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind (F8)."""
    return df.where(F.col("kind") == kind)


def matches_focus(state: str = "state_fips", geoid: str = "geoid") -> Column:
    """Whether either code is the focus code."""
    return F.coalesce(F.col(state) == fixed.FOCUS_FIPS, F.lit(False)) | F.coalesce(
        F.col(geoid) == fixed.FOCUS_FIPS, F.lit(False)
    )


def label_focus(
    polygons: DataFrame, order: str = "oid", match: Column | None = None, set_id: str | None = None
) -> DataFrame:
    """Labels the first match in ``order`` as focus, all others as outside.

    Adds ``kind`` and ``draw_order``, 0 for outside and 1 for focus, so focus comes last. A set
    without a match is an error, whatever columns are read; a table without rows has no set. NULL set
    ids form a set of their own. ``order`` must be unique within a set.

    One set: the focus row is a scalar subquery, two-phase aggregated, and labelling needs no
    shuffle. Many sets: the focus of each set is joined back on ``set_id``.
    """
    match = matches_focus() if match is None else match
    missing = F.raise_error(F.lit(fixed.BOUNDARY_MISSING_ERROR))
    if set_id is None:
        focus = polygons.where(match).agg(F.min(order)).scalar()
        labelled = polygons.withColumn("focus_order", focus)
    else:
        first = F.min(F.when(match, F.col(order))).alias("focus_order")
        focus = polygons.groupBy(set_id).agg(first)
        labelled = lookup_join(polygons, focus, [set_id])
    # The check is a filter, so it runs whatever columns are read later.
    labelled = labelled.where(F.col("focus_order").isNotNull() | missing.cast("boolean"))
    is_focus = F.col(order) == F.col("focus_order")
    kind = F.when(is_focus, fixed.FOCUS_KIND).otherwise(fixed.OUTSIDE_KIND)
    return (
        with_kind(labelled, kind)
        .withColumn("draw_order", F.when(F.col("kind") == fixed.FOCUS_KIND, 1).otherwise(0))
        .drop("focus_order")
    )
