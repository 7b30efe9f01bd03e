"""Feature shaping: records to point features, number fields, bounds and type filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.functions.numbers import finite_number
from embergrid.functions.once import with_once
from embergrid.functions.text import first_text

POLYGON_TYPES = ("Polygon", "MultiPolygon")


def camera_features(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cameras of the state with finite coordinates, flattened.

    The state is compared without case and kept as sent.
    """
    in_state = records.where(F.upper("site.state") == fixed.CAMERA_STATE)
    placed = with_once(
        in_state,
        lon=finite_number(F.col("site.longitude")),
        lat=finite_number(F.col("site.latitude")),
    )
    return placed.where("lon IS NOT NULL AND lat IS NOT NULL").select(
        *keep,
        F.col("site.id").alias("id"),
        first_text(F.col("name"), F.col("source"), F.lit(fixed.CAMERA_TITLE)).alias("name"),
        F.col("position.pan").alias("pan"),
        F.col("image.url").alias("image"),
        F.col("site.state").alias("state"),
        F.col("site.county").alias("county"),
        "lon",
        "lat",
    )


def first_finite(sources: Sequence[str]) -> Column:
    """First finite number among text columns, in the given order; NULL when there is none."""
    return F.coalesce(*[finite_number(F.col(name)) for name in sources])


def numeric_property(df: DataFrame, target: str, sources: Sequence[str]) -> DataFrame:
    """Adds ``target`` from the first alias that is a finite number, else NULL (T5)."""
    return df.withColumn(target, first_finite(sources))


def point_columns(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds ``lon`` and ``lat`` of a Point, or of a MultiPoint's first position (T4).

    ``geometry`` is a VARIANT holding a GeoJSON geometry. Positions may hold quoted numbers;
    other geometry types give NULL.
    """
    kind = F.try_variant_get(geometry, "$.type", "string")
    first = F.when(
        kind == "Point", F.try_variant_get(geometry, "$.coordinates", "variant")
    ).when(kind == "MultiPoint", F.try_variant_get(geometry, "$.coordinates[0]", "variant"))
    texts = with_once(
        with_once(df, _first=first),
        _lon=F.try_variant_get("_first", "$[0]", "string"),
        _lat=F.try_variant_get("_first", "$[1]", "string"),
    )
    points = with_once(texts, lon=finite_number(F.col("_lon")), lat=finite_number(F.col("_lat")))
    return points.drop("_first", "_lon", "_lat")


def in_bounds(
    df: DataFrame,
    bounds: tuple[float, float, float, float] = fixed.DATA_BOUNDS,
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Rows inside west, south, east, north, all four sides included; no point, no row."""
    west, south, east, north = bounds
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def polygons_only(df: DataFrame, geom_type: str = "geom_type") -> DataFrame:
    """Polygon and MultiPolygon rows."""
    return df.where(F.col(geom_type).isin(*POLYGON_TYPES))


def in_list(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is one of the values."""
    return df.where(F.col(column).isin(*values))


def feature_key(property_id: str, feature_id: str) -> Column:
    """Property id, else feature id, else NULL (T10). Site ids need not be unique per camera."""
    return F.coalesce(F.col(property_id).cast("string"), F.col(feature_id).cast("string"))
