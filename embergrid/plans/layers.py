"""The five layers: from landed feeds to tables, each failing on its own."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.operators.classify import label_focus
from embergrid.operators.features import (
    camera_features,
    in_bounds,
    in_list,
    numeric_property,
    point_columns,
    polygons_only,
)
from embergrid.operators.geometry import (
    polygon_edges,
    rings_from_geojson,
    round_edges,
    shaped_rings,
    thin_edges,
)
from embergrid.operators.paging import page_status
from embergrid.schemas import LAYERS, LOAD_STATUS, empty_frame
from embergrid.sources import versions
from embergrid.sources.camera_feed import read_camera_feed
from embergrid.sources.landed_pages import (
    NUMBER_KIND,
    page_facts,
    page_features,
    page_outcomes,
    property_text,
)
from embergrid.sources.sinks import read_features

log = logging.getLogger(__name__)

Loader = Callable[[], DataFrame]

# Column names of the provider fields.
FIRE_COLUMNS = (
    "incident_name",
    "incident_size",
    "percent_contained",
    "poo_county",
    "poo_state",
    "incident_type_category",
)
PERIMETER_COLUMNS = (
    "poly_incident_name",
    "attr_incident_name",
    "poly_gisacres",
    "attr_percent_contained",
    "attr_poo_county",
    "attr_poo_state",
    "attr_incident_type_category",
)


# Rings of one polygon as landed; numbers may be quoted.
POLYGON_POSITIONS = "array<array<array<string>>>"


class MissingBoundary(Exception):
    """The boundary layer has no polygon."""


class IncompletePages(Exception):
    """The landed pages of a layer are not a whole layer."""


def require_complete(
    pages: DataFrame, page_size: int = fixed.PAGE_SIZE, facts: DataFrame | None = None
) -> int:
    """Offset of the last page of one layer; raises when its landed pages are not a whole layer.

    The reason is the first page that failed and was not fetched again, if there is one. One row
    comes back to the driver. With the stored ``facts`` of the pages, no body is parsed for it.
    """
    good = page_facts(pages) if facts is None else facts.where(F.col("outcome") == "ok")
    state = page_status(good, page_size).first()
    if state is not None and state["status"] == "complete":
        return state["stop_at"]
    failed = (
        (page_outcomes(pages) if facts is None else facts)
        .groupBy("result_offset")
        .agg(F.bool_or(F.col("outcome") == "ok").alias("ok"), F.max("message").alias("message"))
        .where(~F.col("ok"))
        .agg(F.min_by("message", "result_offset"))
        .first()[0]
    )
    if failed is None and state is not None and state["status"] == "not_advanced":
        failed = fixed.NOT_ADVANCED_ERROR
    raise IncompletePages(failed or f"pages: {state['status'] if state else 'none landed'}")


def _texts(fields: tuple[str, ...], columns: tuple[str, ...]) -> list[Column]:
    return [
        property_text(field).alias(column) for field, column in zip(fields, columns, strict=True)
    ]


def _geometry_text() -> Column:
    return F.to_json("geometry").alias("geometry")


def _sent() -> Column:
    return F.col("properties").alias("sent")


def camera_layer(records: DataFrame) -> DataFrame:
    """Cameras from raw records."""
    return camera_features(records)


def fire_layer(pages: DataFrame) -> DataFrame:
    """Fire incidents of the state, with ``acres``."""
    fires = (
        point_columns(page_features(pages))
        .select("feature_id", *_texts(fixed.FIRE_FIELDS, FIRE_COLUMNS), "lon", "lat", _sent())
        .where(F.col("poo_state") == fixed.STATE_CODE)
    )
    return numeric_property(fires, "acres", ["incident_size"])


def perimeter_layer(pages: DataFrame) -> DataFrame:
    """Fire perimeters of the state; geometry as GeoJSON text."""
    perimeters = (
        page_features(pages)
        .select(
            "feature_id",
            *_texts(fixed.PERIMETER_FIELDS, PERIMETER_COLUMNS),
            "geom_type",
            _geometry_text(),
            _sent(),
        )
        .where(F.col("attr_poo_state") == fixed.STATE_CODE)
    )
    return with_shape(perimeters, fixed.PERIMETER_PRECISION, fixed.PERIMETER_MAX_OFFSET)


def burn_layer(pages: DataFrame) -> DataFrame:
    """Planned burns with a point inside the bounds.

    A number is a start in epoch milliseconds, text is a date string; a quoted number is text.
    """
    start = F.try_variant_get("properties", "$.prescribed_date_start", "variant")
    kind = F.schema_of_variant(start)
    is_text = kind == "STRING"
    is_number = kind.rlike(NUMBER_KIND)
    burns = point_columns(page_features(pages)).select(
        "feature_id",
        property_text("name").alias("name"),
        F.when(is_number, F.try_variant_get(start, "$", "bigint")).alias("start_ms"),
        F.when(is_text, F.try_variant_get(start, "$", "string")).alias("start_text"),
        property_text("watchduty_url").alias("watchduty_url"),
        property_text("acreage").alias("acreage"),
        "lon",
        "lat",
        _sent(),
    )
    return in_bounds(burns)


def boundary_layer(pages: DataFrame) -> DataFrame:
    """State polygons labelled focus or outside; ``oid`` is the place in landing order."""
    polygons = in_list(
        polygons_only(page_features(pages)).select(
            (F.col("result_offset") + F.col("pos")).alias("oid"),
            *_texts(fixed.BOUNDARY_FIELDS, ("state_fips", "geoid")),
            "geom_type",
            _geometry_text(),
            _sent(),
        ),
        "state_fips",
        fixed.STATE_FIPS,
    )
    shaped = with_shape(polygons, fixed.BOUNDARY_PRECISION, fixed.BOUNDARY_MAX_OFFSET)
    return label_focus(shaped)


def whole_boundary_layer(pages: DataFrame) -> DataFrame:
    """The boundary layer, which is an error without any polygon, as it is without the focus (B2)."""
    layer = boundary_layer(pages)
    if layer.isEmpty():
        raise MissingBoundary(fixed.BOUNDARY_MISSING_ERROR)
    return layer


def with_shape(layer: DataFrame, decimals: int, max_offset: float) -> DataFrame:
    """Polygon geometry thinned and rounded, as GeoJSON text (G1, G2); other geometry stays.

    A polygon is one value of its row, so this is a row expression; ``edges_of`` does the same on
    edge tables.
    """
    document = F.try_parse_json("geometry")
    kind = F.try_variant_get(document, "$.type", "string")
    single = F.array(F.try_variant_get(document, "$.coordinates", POLYGON_POSITIONS))
    many = F.try_variant_get(document, "$.coordinates", f"array<{POLYGON_POSITIONS}>")
    parts = F.transform(
        F.when(kind == "Polygon", single).otherwise(many),
        lambda rings: shaped_rings(rings, decimals, max_offset),
    )
    filled = F.filter(parts, lambda rings: F.size(rings) > 0)

    def text(coordinates: Column) -> Column:
        return F.to_json(F.struct(kind.alias("type"), coordinates.alias("coordinates")))

    empty = F.array().cast(POLYGON_POSITIONS.replace("string", "double"))
    shaped = F.when(kind == "Polygon", text(F.coalesce(F.get(filled, F.lit(0)), empty))).when(
        kind == "MultiPolygon", text(filled)
    )
    return layer.withColumn("geometry", F.coalesce(shaped, F.col("geometry")))


def edges_of(
    layer: DataFrame, geom_id: str, decimals: int | None = None, max_offset: float | None = None
) -> DataFrame:
    """Edge table of a polygon layer whose ``geometry`` is GeoJSON text, thinned then rounded."""
    polygons = layer.withColumn("rings", rings_from_geojson(F.try_parse_json("geometry")))
    edges = polygon_edges(polygons, geom_id)
    if max_offset is not None:
        edges = thin_edges(edges, max_offset, geom_id)
    return edges if decimals is None else round_edges(edges, decimals)


def loaders(
    spark: SparkSession, camera_path: str, pages: DataFrame, facts: DataFrame | None = None
) -> dict[str, Loader]:
    """A loader per layer. ``pages`` is the landed page table of all paged layers.

    With ``facts``, those of the same pages as ``record_facts`` stores them, a load parses each body
    once, to build the layer.
    """

    def paged(
        layer: str, build: Callable[[DataFrame], DataFrame], page_size: int = fixed.PAGE_SIZE
    ) -> Loader:
        def load() -> DataFrame:
            own = pages.where(F.col("layer") == layer)
            own_facts = None if facts is None else facts.where(F.col("layer") == layer)
            last = require_complete(own, page_size, own_facts)
            return build(own.where(F.col("result_offset") <= last))

        return load

    return {
        "cameras": lambda: camera_layer(read_camera_feed(spark, camera_path)),
        "fires": paged("fires", fire_layer),
        "perimeters": paged("perimeters", perimeter_layer, fixed.PERIMETER_PAGE_SIZE),
        "burns": paged("burns", burn_layer),
        "boundary": paged("boundary", whole_boundary_layer),
    }


# Conditions under which Spark reports bad data: payloads refused by name, texts that are no values,
# a place where nothing has landed, and fields that are not there.
DATA_CONDITIONS = (
    "USER_RAISED_EXCEPTION",
    "CAST_INVALID_INPUT",
    "MALFORMED_RECORD_IN_PARSING",
    "PATH_NOT_FOUND",
    "UNRESOLVED_COLUMN",
    "FIELD_NOT_FOUND",
    "DATATYPE_MISMATCH",
)


def is_data_error(error: Exception) -> bool:
    """Whether a layer failed by its data; a lost executor or a full disk says nothing about it."""
    if isinstance(error, (IncompletePages, MissingBoundary)):
        return True
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return condition is not None and condition.startswith(DATA_CONDITIONS)


def _message(error: Exception) -> str:
    lines = str(error).splitlines()
    return lines[0] if lines and lines[0].strip() else type(error).__name__


def guarded(
    spark: SparkSession, name: str, load: Loader, schema: str, use: Callable[[DataFrame], int]
) -> tuple[DataFrame, tuple[str, bool, str | None, int]]:
    """A layer and its ``load_status`` row: the loaded table, or an empty one of its schema.

    Only bad data empties a layer; other errors are raised. Spark is lazy, so ``use``, which reads the
    table and gives its row count, runs inside the guard.
    """
    try:
        frame = load()
        return frame, (name, True, None, use(frame))
    except Exception as error:
        if not is_data_error(error):
            raise
        log.error("layer %s failed: %s", name, error)
        return empty_frame(spark, schema), (name, False, _message(error), 0)


def load_status(
    spark: SparkSession, layer_loaders: Mapping[str, Loader], schemas: Mapping[str, str]
) -> DataFrame:
    """Loads all layers side by side and says how each went: ``layer, ok, error, rows``.

    One row per layer passes the driver; each thread only starts Spark jobs.
    """

    def state(name: str) -> tuple[str, bool, str | None, int]:
        return guarded(spark, name, layer_loaders[name], schemas[name], DataFrame.count)[1]

    with ThreadPoolExecutor(max_workers=len(layer_loaders)) as pool:
        return spark.createDataFrame(list(pool.map(state, layer_loaders)), LOAD_STATUS)


def publish_layers(
    spark: SparkSession,
    layer_loaders: Mapping[str, Loader],
    path: str,
    schemas: Mapping[str, str] = LAYERS,
) -> DataFrame:
    """Loads and publishes all layers side by side; returns ``load_status``.

    Each layer is written as a new version, which a commit makes the current one when it is whole. A
    layer with bad data gets an empty version, while the others go on. Any other error leaves the
    layer's last version in use; it is raised when all layers are done.
    """

    def publish(name: str) -> tuple[str, bool, str | None, int]:
        version = versions.new_version()
        folder = f"{versions.data_folder(path, version)}/layer={name}"

        def use(frame: DataFrame) -> int:
            frame.write.parquet(folder)
            return spark.read.schema(schemas[name]).parquet(folder).count()

        frame, status = guarded(spark, name, layer_loaders[name], schemas[name], use)
        if not status[1]:
            # The folder of a write that broke off is not used again.
            version = versions.new_version()
            frame.write.parquet(f"{versions.data_folder(path, version)}/layer={name}")
        versions.commit(spark, f"{path}/{name}", version, [status])
        return status

    with ThreadPoolExecutor(max_workers=len(layer_loaders)) as pool:
        results = [pool.submit(publish, name) for name in layer_loaders]
    return spark.createDataFrame([result.result() for result in results], LOAD_STATUS)


def layer_versions(spark: SparkSession, path: str, schemas: Mapping[str, str] = LAYERS) -> DataFrame:
    """The commit that counts, for each published layer: ``layer, seq, version, ok, error, rows``."""
    parts = [versions.current(spark, f"{path}/{name}") for name in schemas]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def read_layers(
    spark: SparkSession, path: str, schemas: Mapping[str, str] = LAYERS
) -> dict[str, DataFrame]:
    """Current versions of the published layers, by name; one never published is empty."""
    # One row per layer.
    chosen = {row["layer"]: row["version"] for row in layer_versions(spark, path, schemas).collect()}
    return {
        name: spark.read.schema(schema).parquet(f"{versions.data_folder(path, chosen[name])}/layer={name}")
        if name in chosen
        else empty_frame(spark, schema)
        for name, schema in schemas.items()
    }


def as_features(
    df: DataFrame,
    layer: str,
    feature_id: str,
    properties: tuple[str, ...],
    geom_type: str,
    derived: tuple[str, ...] = (),
) -> DataFrame:
    """A layer in the common feature shape; a ``geom_type`` column wins over the given type.

    ``geometry`` is GeoJSON text: the layer's own, or that of its point. ``properties`` is a JSON
    object. Where the layer has its properties as ``sent``, the object is these, each with the type it
    came with, and the ``derived`` ones that were not sent under that name; else it is made of both
    lists of columns, without missing values. ``sent`` stays a VARIANT, NULL where the layer has none:
    it is stored in typed parts, so a filter on one property reads that part only and skips row groups.
    """
    present = set(df.columns)

    def coordinate(name: str) -> Column:
        value = F.col(name) if name in present else F.lit(None).cast("double")
        return value.alias(name)

    if "geometry" in present:
        geometry = F.col("geometry")
    else:
        point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
        placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
        geometry = F.when(placed, F.to_json(point))
    if "sent" in present:
        text, sent = _sent_and(derived), F.col("sent")
    else:
        text, sent = F.to_json(F.struct(*properties, *derived)), F.lit(None).cast("variant")
    return df.select(
        F.lit(layer).alias("layer"),
        F.col(feature_id).cast("string").alias("feature_id"),
        (F.col("geom_type") if "geom_type" in present else F.lit(geom_type)).alias("geom_type"),
        coordinate("lon"),
        coordinate("lat"),
        geometry.alias("geometry"),
        text.alias("properties"),
        sent.alias("sent"),
    )


def _sent_and(derived: tuple[str, ...]) -> Column:
    """JSON text of the ``sent`` object, with the derived columns that it has no key for."""
    is_object = F.coalesce(F.schema_of_variant("sent").startswith("OBJECT"), F.lit(False))
    sent = F.when(is_object, F.to_json("sent")).otherwise("{}")
    if not derived:
        return sent
    missing = [
        F.when(F.try_variant_get("sent", f"$.{name}", "variant").isNull(), F.col(name)).alias(name)
        for name in derived
    ]
    own = F.to_json(F.struct(*missing))
    # JSON text holds no line break of its own, so the joint of the two is the only one.
    return F.when(own == "{}", sent).when(sent == "{}", own).otherwise(
        F.regexp_replace(F.concat_ws("\n", sent, own), r"\}\n\{", ",")
    )


# Id, properties, geometry type and derived properties of each layer in the feature table.
FEATURE_SHAPES = {
    "cameras": ("id", ("id", "name", "pan", "image", "state", "county"), "Point"),
    "fires": ("feature_id", FIRE_COLUMNS, "Point", ("acres",)),
    "perimeters": ("feature_id", PERIMETER_COLUMNS, "Polygon"),
    "burns": ("feature_id", ("name", "start_ms", "start_text", "watchduty_url", "acreage"), "Point"),
    "boundary": ("oid", ("state_fips", "geoid"), "Polygon", ("kind",)),
}


def features_union(layers: Mapping[str, DataFrame]) -> DataFrame:
    """All published layers as one feature table."""
    parts = [as_features(df, name, *FEATURE_SHAPES[name]) for name, df in layers.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def layer_groups(spark: SparkSession, visible: Mapping[str, bool] | None = None) -> DataFrame:
    """Layer-group dimension: a handful of fixed rows; ``visible`` overrides the defaults."""
    return spark.createDataFrame(
        _group_rows(visible), "layer_group STRING, layer STRING, source STRING, visible BOOLEAN"
    )


def _group_rows(visible: Mapping[str, bool] | None) -> list[tuple[str, str, str, bool]]:
    chosen = visible or {}
    return [
        (group, layer, fixed.LAYER_SOURCES.get(layer, layer), chosen.get(group, default))
        for group, default, layers in fixed.LAYER_GROUPS
        for layer in layers
    ]


def visible_features(features: DataFrame, visible: Mapping[str, bool] | None = None) -> DataFrame:
    """Features that no group hides: layers of groups that are on, and layers of no group.

    The groups are fixed values, so hidden layers are a value list, and their partitions, or their
    whole branches of a union, are not read.
    """
    rows = _group_rows(visible)
    shown = {source for _, _, source, on in rows if on}
    hidden = sorted({source for _, _, source, _ in rows} - shown)
    return features.where(F.coalesce(~F.col("layer").isin(*hidden), F.lit(True)))


def read_visible_features(spark: SparkSession, path: str, groups: DataFrame) -> DataFrame:
    """Features of a published table that a group table of the caller's does not hide.

    ``groups``: ``source, visible``, one row per group and source layer, as ``layer_groups`` gives. A
    layer is shown when any of its groups is on, or when it is in none; a NULL ``visible`` is off, and
    a NULL ``source`` counts for nothing. The groups are read when the query runs. The layers that the
    table has, which the commit log names, are joined with it and the rest are not read: the join
    prunes the partitions of ``layer`` at run time.
    """
    on = F.max(F.coalesce("visible", F.lit(False)).cast("int"))
    hidden = groups.groupBy(F.col("source").alias("layer")).agg(on.alias("shows")).where(F.col("shows") < 1)
    # One row per layer on both sides.
    shown = versions.current(spark, path).where(F.col("rows") > 0).select("layer").join(hidden, "layer", "left_anti")
    return read_features(spark, path).join(F.broadcast(shown), "layer", "left_semi")
