"""Layer tables out: versions of layers, one partitioned feature table, GeoJSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.schemas import FEATURES, LAYERS
from embergrid.sources import versions


def write_features(
    features: DataFrame, path: str, layers: Sequence[str] = tuple(LAYERS), cluster: bool = False
) -> None:
    """Replaces ``layers`` in the feature table by a new version; one without rows ends empty.

    Rows of other layers are not written, and other layers in the table stay. All layers change in
    one step, after the last file is written. ``cluster`` sorts files by place so that a bounds filter
    can skip row groups. The range keys end in the feature id, so rows at one spot can still be spread
    over several files.
    """
    features = features.where(F.col("layer").isin(*layers))
    if cluster:
        cell = [F.floor(F.col(name) * 4).alias(f"_{name}") for name in ("lat", "lon")]
        keys = ["layer", "_lat", "_lon", "feature_id"]
        placed = features.select("*", *cell)
        features = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        features = features.drop("_lat", "_lon")
    versions.publish(features, path, layers)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The current feature table."""
    names = [part.split(" ")[0] for part in FEATURES.split(", ")]
    return versions.read(spark, path, FEATURES).select(*names)


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row as text in ``value``; a missing geometry is null.

    ``geometry`` and ``properties`` are JSON texts already and go in as they are.
    """
    identity = F.coalesce(F.to_json(F.array("feature_id"), {"ignoreNullFields": "false"}), F.lit("[null]"))
    value = F.concat(
        F.lit('{"type":"Feature","id":'),
        F.expr("substring(_id, 2, length(_id) - 2)"),
        F.lit(',"geometry":'),
        F.coalesce("geometry", F.lit("null")),
        F.lit(',"properties":'),
        F.coalesce("properties", F.lit("{}")),
        F.lit("}"),
    )
    return features.withColumn("_id", identity).select("layer", value.alias("value"))


def write_geojson_lines(
    features: DataFrame, path: str, layers: Sequence[str] = tuple(LAYERS)
) -> None:
    """GeoJSON text, one feature per line, as a new version of ``layers``."""
    own = features.where(F.col("layer").isin(*layers))
    versions.publish(geojson_lines(own), path, layers, text=True)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """``layer, value`` of the current lines."""
    lines = versions.read(spark, path, "value STRING, layer STRING", text=True)
    return lines.select("layer", "value")
