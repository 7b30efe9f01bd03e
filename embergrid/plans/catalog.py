"""Registered queries: each runs operators over a whole given or derived table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.operators.cards import (
    burn_cards,
    camera_cards,
    camera_previews,
    fire_cards,
    fire_union,
)
from embergrid.operators.classify import fire_class, fire_size, label_focus, of_kind
from embergrid.operators.features import (
    camera_features,
    feature_key,
    in_bounds,
    in_list,
    numeric_property,
    point_columns,
    polygons_only,
)
from embergrid.operators.geometry import boxes_overlapping, edge_boxes, polygons_in_envelope, round_edges, thin_edges
from embergrid.operators.page_directory import page_between, page_directory
from embergrid.operators.paging import assign_pages, page_slice, page_status
from embergrid.operators.query import feature_query
from embergrid.operators.simplify import simplify_edges
from embergrid.operators.skew import BROADCAST_ROWS, lookup_join
from embergrid.operators.spatial import clip_points, points_in_polygons, top_by_draw_order, top_polygon
from embergrid.plans import inputs
from embergrid.plans.layers import (
    IncompletePages,
    Loader,
    as_features,
    edges_of,
    layer_versions,
    load_status,
    loaders,
    publish_layers,
    read_layers,
    read_visible_features,
    require_complete,
    visible_features,
    with_shape,
)
from embergrid.plans.layers import features_union as union_of_layers
from embergrid.session import scratch_path
from embergrid.sources.camera_feed import camera_records, payload_shapes, read_camera_feed
from embergrid.sources.landed_pages import (
    NUMBER_KIND,
    page_facts,
    page_features,
    page_outcomes,
    property_text,
    read_landed_pages,
    refetch_list,
)
from embergrid.sources.sinks import geojson_lines, read_features, write_features
from embergrid.streaming.page_facts import read_facts, record_facts

Query = Callable[[SparkSession, str], DataFrame]

# Box used to show the overlap filter.
INNER_BOUNDS = (-122.0, 43.0, -119.0, 45.0)

# Offset used to show the simplification of common borders.
DISTRICT_OFFSET = 0.003

EVENT_LAYERS = ("click", "error", "purchase", "signup", "view")


def cameras_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_features(inputs.raw_cameras(spark, sf_dir), keep=["cam_key"])


def camera_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_features(camera_records(inputs.camera_payloads(spark, sf_dir)))


def camera_feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of payloads landed as files, read by byte ranges."""
    folder = scratch_path(spark, "feed")
    inputs.camera_payloads(spark, sf_dir, 5_000).write.partitionBy("feed").text(folder)
    return camera_features(read_camera_feed(spark, f"{folder}/*/*"))


def camera_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_cards(cameras_in_state(spark, sf_dir), keep=["cam_key"])


def camera_preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camera_previews(cameras_in_state(spark, sf_dir), keep=["cam_key"])


def feature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = inputs.derived(spark, sf_dir, "fx_cameras")
    with_id = cameras.withColumn("id", F.when(F.col("pan").isNotNull(), F.col("site_id")))
    return with_id.select("cam_key", feature_key("id", "cam_key").alias("feature_key"))


def fires_acres(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = inputs.derived(spark, sf_dir, "fx_fires")
    with_acres = numeric_property(fires, "acres", ["incident_size"])
    both = numeric_property(with_acres, "first_number", ["incident_size", "percent_contained"])
    return both.select("objectid", "acres", "first_number")


def fire_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = inputs.derived(spark, sf_dir, "fx_fires")
    acres = F.col("acres")
    return numeric_property(fires, "acres", ["incident_size"]).select(
        "objectid",
        "acres",
        fire_size(acres).alias("marker_size"),
        fire_class(acres).alias("class_id"),
    )


def fire_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = numeric_property(
        inputs.derived(spark, sf_dir, "fx_fires"), "acres", ["incident_size"]
    ).withColumn("feature", F.concat(F.lit("point "), F.col("objectid").cast("string")))
    perimeters = inputs.derived(spark, sf_dir, "fx_perimeters").withColumn(
        "feature", F.concat(F.lit("perimeter "), F.col("geom_id").cast("string"))
    )
    return fire_cards(fire_union(fires, perimeters), keep=["feature"])


def fires_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_query(
        inputs.derived(spark, sf_dir, "fx_fires"),
        where=f"poo_state = '{fixed.STATE_CODE}'",
        fields=["objectid", "incident_name", "poo_state", "lon", "lat"],
        order_by=None,
        precision=2,
    )


def burns_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    burns = inputs.burn_features(spark, sf_dir)
    points = point_columns(burns.withColumn("geometry", F.try_parse_json("geometry")))
    return in_bounds(points).select("event_id", "geom_type", "lon", "lat")


def burn_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    burns = inputs.derived(spark, sf_dir, "fx_burns")
    return burn_cards(burns, keep=["event_id"])


def boundary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = polygons_only(inputs.derived(spark, sf_dir, "fx_boundary"))
    return label_focus(polygons).select("oid", "geom_type", "kind", "draw_order")


def boundary_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_kind(boundary_kinds(spark, sf_dir), fixed.OUTSIDE_KIND).select("oid", "kind")


def boundary_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_list(
        inputs.derived(spark, sf_dir, "fx_boundary"), "state_fips", fixed.STATE_FIPS
    ).select("oid", "state_fips")


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = inputs.derived(spark, sf_dir, "fx_landed")
    return landed.select(
        F.lit("landed").alias("layer"),
        F.col("request_id").alias("result_offset"),
        "request_id",
        "http_status",
        "body",
    )


def landed_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_outcomes(_landed(spark, sf_dir)).select(
        "request_id", "outcome", "error_code", "retryable", "message", "preview"
    )


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(_landed(spark, sf_dir)).select("request_id", "page_len", "exceeded")


def pages_to_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refetch_list(_landed(spark, sf_dir))


def page_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inputs.page_table(spark, sf_dir)
    return page_status(pages, inputs.EVENT_PAGE_SIZE).select("layer", "status", "pages")


def recorded_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-set status from facts stored while pages land: the broken sets in two landings, none twice."""
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "page-facts")
    # The landing is told by the offset, so every layer comes in both.
    pages = inputs.broken_event_pages(spark, sf_dir).persist()
    try:
        for part in (0, 1):
            own = pages.where(F.floor(F.col("result_offset") / inputs.EVENT_PAGE_SIZE) % 2 == part)
            own.write.mode("append").parquet(landed)
            record_facts(spark, landed, path)
    finally:
        pages.unpersist()
    good = read_facts(spark, path).where(F.col("outcome") == "ok")
    status = page_status(good, inputs.EVENT_PAGE_SIZE)
    return status.select("layer", "status", "pages")


def paged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = page_features(inputs.landed_event_pages(spark, sf_dir))
    return features.select(
        "layer",
        "result_offset",
        "pos",
        "feature_id",
        property_text("value").cast("double").alias("value"),
    )


def event_page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return page_slice(events, "event_id", offset=fixed.PAGE_SIZE // 2)


def part_page_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late page in the order of a text, by a stored directory of many buckets."""
    parts = inputs.table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("name"), "p_partkey"
    )
    path = scratch_path(spark, "page-directory")
    page_directory(parts, "name", bucket_rows=100).write.parquet(path)
    return page_between(parts, "name", spark.read.parquet(path), offset=750, limit=600)


def edges_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of whole polygons of an edge table, through the feature query."""
    return feature_query(inputs.edges(spark, sf_dir), offset=20, limit=50)


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey")
    return assign_pages(orders, "o_orderkey")


def page_numbers_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per customer group; a seventh of the rows has no group, one row no key."""
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 5 END").alias("grp"),
        F.expr("CASE WHEN o_orderkey = 7 THEN NULL ELSE o_orderkey END").alias("id"),
    )
    return assign_pages(orders, "id", 100, by=["grp"])


def boundary_kinds_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus and outside per set; one set has no id."""
    polygons = inputs.table(spark, sf_dir, "supplier").select(
        F.expr("CASE s_nationkey % 4 WHEN 0 THEN NULL ELSE s_nationkey % 4 END").alias("set_id"),
        F.col("s_suppkey").alias("oid"),
        F.expr("s_suppkey % 3 = 1").alias("hit"),
    )
    labelled = label_focus(polygons, match=F.col("hit"), set_id="set_id")
    return labelled.select("set_id", "oid", "kind", "draw_order")


def feature_query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late page of a layer in its default order."""
    fires = inputs.derived(spark, sf_dir, "fx_fires").select("objectid", "poo_state", "lon", "lat")
    return feature_query(fires, where="poo_state = 'US-OR'", offset=4_000, limit=3_000, precision=2)


def edges_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the polygons that meet a box, through the feature query."""
    edges = inputs.edges(spark, sf_dir)
    return feature_query(edges, bounds=INNER_BOUNDS, precision=3, order_by=None)


def feed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_shapes(inputs.derived(spark, sf_dir, "fx_payloads"), "payload", "feed")


def event_load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the load of each event layer went; two have broken page sets."""
    pages = inputs.broken_event_pages(spark, sf_dir).persist()

    def loader(layer: str) -> Loader:
        def load() -> DataFrame:
            own = pages.where(F.col("layer") == layer)
            last = require_complete(own, inputs.EVENT_PAGE_SIZE)
            return page_features(own.where(F.col("result_offset") <= last)).select("feature_id")

        return load

    try:
        loads = {layer: loader(layer) for layer in EVENT_LAYERS}
        return load_status(spark, loads, dict.fromkeys(loads, "feature_id STRING"))
    finally:
        pages.unpersist()


def _perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeters with their shape, as published."""
    shapes = inputs.polygon_geojson(spark, sf_dir)
    rows = inputs.derived(spark, sf_dir, "fx_perimeters").join(shapes, "geom_id")
    shaped = with_shape(rows, fixed.PERIMETER_PRECISION, fixed.PERIMETER_MAX_OFFSET)
    kind = F.when(F.col("geom_id") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    return shaped.withColumn("geom_type", kind).withColumn(
        "attr_incident_type_category", F.lit(None).cast("string")
    )


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five layers in their published form."""
    fires = inputs.derived(spark, sf_dir, "fx_fires").withColumnRenamed("objectid", "feature_id")
    none = F.lit(None).cast("string")
    boundary = polygons_only(inputs.derived(spark, sf_dir, "fx_boundary"))
    return {
        "cameras": cameras_in_state(spark, sf_dir),
        "fires": numeric_property(
            fires.withColumn("incident_type_category", none), "acres", ["incident_size"]
        ),
        "perimeters": _perimeters(spark, sf_dir).withColumnRenamed("geom_id", "feature_id"),
        "burns": in_bounds(inputs.derived(spark, sf_dir, "fx_burns")).withColumnRenamed(
            "event_id", "feature_id"
        ),
        "boundary": label_focus(boundary.withColumn("geometry", none)),
    }


def layer_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two publishes of three layers: one is replaced, one has bad data, one meets a lost executor."""
    frames = {name: frame for name, frame in _layers(spark, sf_dir).items() if name in ("cameras", "fires", "burns")}
    schemas = {
        name: ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in frame.schema)
        for name, frame in frames.items()
    }

    def incomplete() -> DataFrame:
        raise IncompletePages("pages: unfinished")

    def lost() -> DataFrame:
        raise SparkRuntimeException("executor lost")

    path = scratch_path(spark, "layers")
    publish_layers(spark, {name: lambda frame=frame: frame for name, frame in frames.items()}, path, schemas)
    in_state = frames["fires"].where(F.col("poo_state") == fixed.STATE_CODE)
    again: dict[str, Loader] = {"fires": lambda: in_state, "burns": incomplete, "cameras": lost}
    try:
        publish_layers(spark, again, path, schemas)
    except SparkRuntimeException:
        # What the lost executor left behind is the layer's last version.
        pass
    current = layer_versions(spark, path, schemas).drop("version", "rows")
    read = [
        frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows")
        for name, frame in read_layers(spark, path, schemas).items()
    ]
    return current.join(read[0].unionByName(read[1]).unionByName(read[2]), "layer")


def layers_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped loaders over landed feeds and pages, published, and read back as one feature table."""
    feed, landed = scratch_path(spark, "feed"), scratch_path(spark, "landed")
    facts, layers, features = (scratch_path(spark, name) for name in ("page-facts", "layers", "features"))
    inputs.camera_payloads(spark, sf_dir, 5_000).write.partitionBy("feed").text(feed)
    inputs.landed_layers(spark, sf_dir).write.parquet(landed)
    record_facts(spark, landed, facts)
    pages = read_landed_pages(spark, landed)
    publish_layers(spark, loaders(spark, f"{feed}/*/*", pages, read_facts(spark, facts)), layers)
    write_features(union_of_layers(read_layers(spark, layers)), features)

    def number(name: str):
        value = F.try_variant_get("sent", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value).rlike(NUMBER_KIND), F.try_variant_get(value, "$", "double"))

    def named(key: str):
        return F.get_json_object("properties", f"$.{key}")

    return read_features(spark, features).select(
        "layer",
        "feature_id",
        "geom_type",
        "lon",
        "lat",
        F.coalesce(named("name"), named("IncidentName"), named("attr_IncidentName"), named("kind")).alias("name"),
        F.coalesce(number("IncidentSize"), number("poly_GISAcres"), number("acreage")).alias("size"),
        named("acres").cast("double").alias("acres"),
        F.size(F.json_object_keys("properties")).alias("n_properties"),
        F.col("geometry").isNotNull().alias("has_geometry"),
    )


def features_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(key: str):
        return F.get_json_object("properties", f"$.{key}")

    return union_of_layers(_layers(spark, sf_dir)).select(
        "layer",
        "feature_id",
        "geom_type",
        "lon",
        "lat",
        F.coalesce(named("name"), named("incident_name"), named("attr_incident_name"), named("kind")).alias("name"),
        F.json_object_keys("properties").alias("_keys"),
        F.col("geometry").isNotNull().alias("has_geometry"),
    ).select("*", F.size("_keys").alias("n_properties")).drop("_keys")


def shown_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = union_of_layers(_layers(spark, sf_dir))
    return visible_features(features, {"prescribed": True}).select("layer", "feature_id")


def shown_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published features by a group table read at run time: one layer in two groups, one in none."""
    path = scratch_path(spark, "features")
    layers = {name: frame for name, frame in _layers(spark, sf_dir).items() if name != "perimeters"}
    write_features(union_of_layers(layers), path, tuple(layers))
    # Groups from the regions: the first two hold fires, off and on, the third burns and the fourth cameras.
    sources = F.array(*map(F.lit, ("fires", "fires", "burns", "cameras")))
    groups = inputs.table(spark, sf_dir, "region").select(
        F.get(sources, F.col("r_regionkey").cast("int")).alias("source"),
        (F.col("r_regionkey") % 2 == 1).alias("visible"),
    )
    return read_visible_features(spark, path, groups).select("layer", "feature_id", "geom_type")


def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and polygons as GeoJSON lines, with text and number properties."""
    fires = numeric_property(
        inputs.derived(spark, sf_dir, "fx_fires"), "acres", ["incident_size"]
    )
    points = as_features(fires, "fires", "objectid", ("poo_state", "acres"), "Point")
    perimeters = _perimeters(spark, sf_dir)
    polygons = as_features(perimeters, "perimeters", "geom_id", ("attr_poo_state",), "Polygon")
    return geojson_lines(points.unionByName(polygons))


def perimeters_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the perimeters as published: thinned, then rounded."""
    edges = edges_of(_perimeters(spark, sf_dir), "geom_id")
    return edges.select("geom_id", "x1", "y1", "x2", "y2")


def geojson_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(inputs.polygon_geojson(spark, sf_dir), "geom_id")


def edges_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_edges(inputs.edges(spark, sf_dir), 2)


def edges_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thin_edges(inputs.edges(spark, sf_dir), 0.05)


def districts_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons that share their borders, simplified without a gap between them."""
    return simplify_edges(inputs.district_edges(spark, sf_dir), DISTRICT_OFFSET)


def perimeter_bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes_overlapping(edge_boxes(inputs.edges(spark, sf_dir)), INNER_BOUNDS)


def perimeters_in_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons_in_envelope(inputs.edges(spark, sf_dir), INNER_BOUNDS)


def fires_in_perimeters(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    fires = inputs.derived(spark, sf_dir, "fx_fires")
    edges = inputs.edges(spark, sf_dir)
    return points_in_polygons(fires, edges, "objectid", broadcast_rows=broadcast_rows)


def top_perimeter_per_fire(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    return top_polygon(fires_in_perimeters(spark, sf_dir, broadcast_rows), "objectid")


def top_perimeter_by_order(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The perimeter drawn last at each fire; a fifth of them has no draw order."""
    order = F.when(F.col("geom_id") % 5 != 0, F.col("geom_id") % 7)
    fires = inputs.derived(spark, sf_dir, "fx_fires")
    edges = inputs.edges(spark, sf_dir)
    orders = inputs.derived(spark, sf_dir, "fx_perimeters").select("geom_id", order.alias("draw_order"))
    return top_by_draw_order(fires, edges, orders, "objectid", broadcast_rows=broadcast_rows)


def fires_clipped(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    fires = inputs.derived(spark, sf_dir, "fx_fires").select("objectid", "lon", "lat")
    edges = inputs.edges(spark, sf_dir)
    return clip_points(fires, edges, "objectid", broadcast_rows=broadcast_rows)


def sites_in_perimeters(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Points with repeated and missing ids."""
    sites = inputs.derived(spark, sf_dir, "fx_sites")
    edges = inputs.edges(spark, sf_dir)
    return points_in_polygons(sites, edges, "site", broadcast_rows=broadcast_rows)


def sites_clipped(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    sites = inputs.derived(spark, sf_dir, "fx_sites")
    return clip_points(sites, inputs.edges(spark, sf_dir), "site", broadcast_rows=broadcast_rows)


def perimeter_hit_cards(
    spark: SparkSession, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """For every fire point, the card of the perimeter on top at its place."""
    hits = top_perimeter_per_fire(spark, sf_dir, broadcast_rows)
    cards = fire_cards(inputs.derived(spark, sf_dir, "fx_perimeters"), keep=["geom_id"])
    joined = lookup_join(hits, cards, ["geom_id"])
    return joined.select("objectid", *cards.columns)


def shuffled(query: Callable[[SparkSession, str, int], DataFrame]) -> Query:
    """The query by the plan for polygon sets of any size."""
    return lambda spark, sf_dir: query(spark, sf_dir, 0)


QUERIES: dict[str, Query] = {
    "cameras_in_state": cameras_in_state,
    "camera_feed": camera_feed,
    "camera_cards": camera_card_rows,
    "camera_previews": camera_preview_rows,
    "feature_keys": feature_keys,
    "fires_acres": fires_acres,
    "fire_classes": fire_classes,
    "fire_cards": fire_card_rows,
    "fires_in_state": fires_in_state,
    "burns_in_bounds": burns_in_bounds,
    "burn_cards": burn_card_rows,
    "boundary_kinds": boundary_kinds,
    "boundary_outside": boundary_outside,
    "boundary_in_list": boundary_in_list,
    "landed_outcome": landed_outcome,
    "page_flags": page_flags,
    "pages_to_refetch": pages_to_refetch,
    "page_completeness": page_completeness,
    "paged_features": paged_features,
    "page_slice": event_page_slice,
    "page_numbers": page_numbers,
    "features_union": features_union,
    "visible_features": shown_features,
    "feature_lines": feature_lines,
    "geojson_edges": geojson_edges,
    "edges_rounded": edges_rounded,
    "edges_thinned": edges_thinned,
    "perimeter_bbox_overlap": perimeter_bbox_overlap,
    "fires_in_perimeters": fires_in_perimeters,
    "top_perimeter_per_fire": top_perimeter_per_fire,
    "fires_clipped": fires_clipped,
    "perimeter_hit_cards": perimeter_hit_cards,
    "sites_in_perimeters": sites_in_perimeters,
    "sites_clipped": sites_clipped,
    "fires_in_perimeters_shuffled": shuffled(fires_in_perimeters),
    "fires_clipped_shuffled": shuffled(fires_clipped),
    "perimeter_hit_cards_shuffled": shuffled(perimeter_hit_cards),
    "sites_in_perimeters_shuffled": shuffled(sites_in_perimeters),
    "sites_clipped_shuffled": shuffled(sites_clipped),
    "page_numbers_by_group": page_numbers_by_group,
    "boundary_kinds_by_set": boundary_kinds_by_set,
    "feature_query_page": feature_query_page,
    "edges_in_bounds": edges_in_bounds,
    "feed_shapes": feed_shapes,
    "load_status": event_load_status,
    "perimeters_shaped": perimeters_shaped,
    "camera_feed_files": camera_feed_files,
    "layer_versions": layer_commits,
    "perimeters_in_envelope": perimeters_in_envelope,
    "layers_loaded": layers_loaded,
    "visible_features_by_groups": shown_by_groups,
    "page_completeness_recorded": recorded_completeness,
    "page_slice_by_text": part_page_by_name,
    "edges_page": edges_page,
    "districts_simplified": districts_simplified,
    "top_perimeter_by_order": top_perimeter_by_order,
}
