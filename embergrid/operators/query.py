"""Feature query with defaults: all rows, all fields, stable id order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid.operators.features import in_bounds
from embergrid.operators.geometry import (
    COORDINATES,
    boxes_overlapping,
    edge_boxes,
    round_edges,
    round_points,
    thin_edges,
)
from embergrid.operators.paging import page_slice

# Id columns of the layers, in the order they are looked for.
ID_COLUMNS = ("OBJECTID", "objectid", "oid", "feature_id", "geom_id", "id")


def id_column(df: DataFrame) -> str:
    """The id column a layer is ordered by."""
    found = next((name for name in ID_COLUMNS if name in df.columns), None)
    if found is None:
        raise ValueError(f"no id column among {df.columns}; give order_by")
    return found


def feature_query(
    df: DataFrame,
    where: str | Column = "true",
    fields: str | list[str] = "*",
    order_by: str | None = "",
    bounds: tuple[float, float, float, float] | None = None,
    precision: int | None = None,
    max_offset: float | None = None,
    offset: int = 0,
    limit: int | None = None,
    geom_id: str = "geom_id",
) -> DataFrame:
    """Query one layer; every argument overrides a default.

    ``where`` is SQL text or a Column. ``bounds`` keeps points inside, and on an edge table the
    polygons ``geom_id`` whose box meets it. ``precision`` rounds point or edge coordinates and
    ``max_offset`` thins edges. The default order is that of the layer's id column;
    ``order_by=None`` leaves out the sort, for whole-layer reads that need no order. A page, by
    ``offset`` or ``limit``, is cut in that order, which must then be unique; on an edge table it
    counts whole polygons.
    """
    rows = df.where(where)
    is_edges = set(COORDINATES) <= set(rows.columns)
    if bounds is not None and is_edges:
        near = boxes_overlapping(edge_boxes(rows, geom_id), bounds).select(geom_id)
        rows = rows.join(near, geom_id, "left_semi")
    elif bounds is not None:
        rows = in_bounds(rows, bounds)
    if max_offset is not None:
        rows = thin_edges(rows, max_offset, geom_id)
    if precision is not None:
        rows = round_edges(rows, precision) if is_edges else round_points(rows, precision)
    if order_by == "":
        order_by = id_column(rows)
    if offset or limit is not None:
        if order_by is None:
            raise ValueError("a page needs an order")
        rows = page_slice(rows, order_by, offset, limit, distinct=is_edges)
    if order_by is not None:
        rows = rows.orderBy(F.col(order_by).asc_nulls_first())
    return rows.select(fields)
