"""Input tables of the registered queries, derived from the star-schema tables.

No geographic data is supplied, so feeds are derived by column expressions. Each expression text is
valid in Spark and in the checking database, so both sides read the same values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.operators.geometry import polygon_edges
from embergrid.operators.paging import assign_pages

# Page size of the derived page tables.
EVENT_PAGE_SIZE = 50

CAMERAS = {
    "cam_key": "c_custkey",
    "name": (
        "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END"
    ),
    "source": (
        "CASE WHEN c_custkey % 22 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL "
        "ELSE c_mktsegment END"
    ),
    "pan": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 360 END",
    "image_url": (
        "CASE c_custkey % 3 "
        "WHEN 0 THEN concat('https://img.example.com/', CAST(c_custkey AS STRING), '.jpg') "
        "WHEN 1 THEN concat('http://img.example.com/', CAST(c_custkey AS STRING), '.jpg') "
        "ELSE NULL END"
    ),
    "site_id": "c_custkey % 97",
    "state": (
        "CASE c_nationkey % 4 WHEN 0 THEN 'OR' WHEN 1 THEN 'or' WHEN 2 THEN 'WA' ELSE NULL END"
    ),
    "county": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END",
    "latitude": (
        "CASE c_custkey % 17 WHEN 0 THEN '' WHEN 1 THEN '12px' WHEN 2 THEN NULL "
        "WHEN 3 THEN 'NaN' "
        "ELSE CAST(CAST(38000 + (c_custkey * 7919) % 12000 AS DOUBLE) / 1000 AS STRING) END"
    ),
    "longitude": (
        "CAST(CAST(-130000 + (c_custkey * 104729) % 20000 AS DOUBLE) / 1000 AS STRING)"
    ),
}

FIRES = {
    "objectid": "o_orderkey",
    "incident_name": (
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL "
        "ELSE concat('Fire ', CAST(o_orderkey AS STRING)) END"
    ),
    "incident_size": (
        "CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '-3' WHEN 3 THEN '0' "
        "WHEN 4 THEN '1' "
        "ELSE CAST(CAST((o_orderkey * 7919) % 2000000 AS DOUBLE) / 100 AS STRING) END"
    ),
    "percent_contained": (
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS STRING) END"
    ),
    "poo_state": "CASE WHEN o_custkey % 4 = 0 THEN 'US-WA' ELSE 'US-OR' END",
    "poo_county": "CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE o_orderpriority END",
    "lon": "CAST(-125000 + (o_orderkey * 104729) % 9000 AS DOUBLE) / 1000",
    "lat": "CAST(41500 + (o_orderkey * 7919) % 5500 AS DOUBLE) / 1000",
}

PERIMETERS = {
    "geom_id": "s_suppkey",
    "poly_incident_name": (
        "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL "
        "ELSE concat('Perimeter ', CAST(s_suppkey AS STRING)) END"
    ),
    "attr_incident_name": "CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE s_name END",
    "poly_gisacres": (
        "CASE WHEN s_suppkey % 5 = 0 THEN NULL "
        "ELSE CAST(CAST((s_suppkey * 7919) % 2000000 AS DOUBLE) / 100 AS STRING) END"
    ),
    "attr_percent_contained": (
        "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey % 101 AS STRING) END"
    ),
    "attr_poo_county": (
        "CASE WHEN s_suppkey % 3 = 0 THEN '' "
        "ELSE concat('County ', CAST(s_nationkey AS STRING)) END"
    ),
    "attr_poo_state": (
        "CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'US-WA' ELSE 'US-OR' END"
    ),
}

BURNS = {
    "event_id": "event_id",
    "name": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE concat(event_type, ' burn') END",
    "acreage": "CASE WHEN event_id % 15 = 0 THEN NULL ELSE value END",
    "start_ms": (
        "CASE WHEN event_id % 10 = 0 THEN NULL "
        "ELSE CAST(1704067200000 + event_id * 3600000 AS BIGINT) END"
    ),
    "start_text": (
        "CASE WHEN event_id % 40 = 0 THEN '11/14/2023 10:00:00 AM' "
        "WHEN event_id % 40 = 10 THEN 'Tue, 14 Nov 2023 00:00:00 GMT' "
        "WHEN event_id % 40 = 20 THEN 'Nov 14 2023' ELSE NULL END"
    ),
    "watchduty_url": (
        "CASE event_id % 4 "
        "WHEN 0 THEN concat('https://burns.example.com/', CAST(event_id AS STRING)) "
        "WHEN 1 THEN concat('http://burns.example.com/', CAST(event_id AS STRING)) "
        "WHEN 2 THEN '' ELSE NULL END"
    ),
    "geom_type": (
        "CASE WHEN event_id % 2 = 0 THEN 'Point' WHEN event_id % 3 = 0 THEN 'Polygon' "
        "ELSE 'MultiPoint' END"
    ),
    "lon": "CAST(-127000 + (event_id * 7919) % 13000 AS DOUBLE) / 1000",
    "lat": "CAST(40000 + (event_id * 104729) % 8000 AS DOUBLE) / 1000",
}

BOUNDARY = {
    "oid": "CAST(n_nationkey AS BIGINT)",
    "state_fips": (
        "CASE n_nationkey % 6 WHEN 0 THEN '41' WHEN 1 THEN '06' WHEN 2 THEN '53' "
        "WHEN 3 THEN '32' WHEN 4 THEN '16' ELSE NULL END"
    ),
    "geoid": "CASE WHEN n_nationkey = 2 THEN '41' ELSE NULL END",
    "geom_type": (
        "CASE WHEN n_nationkey < 2 THEN 'Point' WHEN n_nationkey % 2 = 0 THEN 'Polygon' "
        "ELSE 'MultiPolygon' END"
    ),
}

LANDED = {
    "request_id": "event_id",
    "http_status": (
        "CASE event_id % 8 WHEN 0 THEN 400 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 404 "
        "WHEN 4 THEN 408 ELSE 200 END"
    ),
    "body": (
        "CASE event_id % 11 WHEN 0 THEN '<html>  Bad   gateway </html>' "
        """WHEN 1 THEN '{"error":{"code":500,"message":"busy"}}' """
        """WHEN 2 THEN '{"error":{"message":"no code"}}' """
        """WHEN 3 THEN '{"features":[],"exceededTransferLimit":false}' """
        """WHEN 4 THEN '{"features":[]}]' WHEN 5 THEN '{"features":[]}],[1' """
        """WHEN 6 THEN '{"features":[{"id":1},{"id":2}],"exceededTransferLimit":true}' """
        """WHEN 7 THEN '{"features":[{"id":1}],"exceededTransferLimit":"true"}' """
        """WHEN 8 THEN '{"features":3,"exceededTransferLimit":null}' """
        """WHEN 9 THEN ' {"features":[{"id":1}]} ' """
        """ELSE '{"features":[{"type":"Feature"}],"properties":{"exceededTransferLimit":true}}' """
        "END"
    ),
}

PAYLOADS = {
    "feed": "c_custkey",
    "payload": (
        """CASE c_custkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '[{"name":"a"}] oops' """
        """WHEN 2 THEN '{"a":1}' WHEN 3 THEN '[7,{"name":"b"},null]' WHEN 4 THEN '[1],[2]' """
        """WHEN 5 THEN NULL ELSE ' [ {"name":"c"} ] ' END"""
    ),
}

# Points of which several have one id, and some have none.
SITES = {
    "site": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 500 END",
    "lon": FIRES["lon"],
    "lat": FIRES["lat"],
}

# Polygon outlines around a centre: a hexagon with a dent and a square hole, in thousandths.
OUTER = ((-8, -6), (8, -6), (11, 0), (8, 6), (-8, 6), (-3, 0), (-8, -6))
HOLE = ((1, -2), (5, -2), (5, 2), (1, 2), (1, -2))
CENTRES = {
    "geom_id": "s_suppkey",
    "cx": "CAST(-124000 + (s_suppkey * 7919) % 7000 AS BIGINT)",
    "cy": "CAST(42500 + (s_suppkey * 104729) % 3500 AS BIGINT)",
    "k": "10 + s_suppkey % 40",
}

# Districts side by side: squares of 16 steps a side whose borders wave, the same for both neighbours.
DISTRICTS = {
    "geom_id": "p_partkey",
    "i": "(p_partkey - 1) % 40",
    "j": "CAST(floor((p_partkey - 1) / 40) AS BIGINT)",
}
DISTRICT_STEPS = 64
DISTRICT_GRID = {
    "gx": "CASE WHEN t < 16 THEN 16 * i + t WHEN t < 32 THEN 16 * i + 16 WHEN t < 48 THEN 16 * i + 48 - t ELSE 16 * i END",
    "gy": "CASE WHEN t < 16 THEN 16 * j WHEN t < 32 THEN 16 * j + t - 16 WHEN t < 48 THEN 16 * j + 16 ELSE 16 * j + 64 - t END",
}
_WAVE = "(gx * 7919 + gy * 104729) % 9 - 4"
DISTRICT_PLACE = {
    "x": f"CAST(5 * gx + CASE WHEN gy % 16 = 0 THEN 0 ELSE {_WAVE} END AS DOUBLE) / 1000",
    "y": f"CAST(5 * gy + CASE WHEN gx % 16 = 0 THEN 0 ELSE {_WAVE} END AS DOUBLE) / 1000",
}

COLUMNS = {
    "fx_cameras": ("customer", CAMERAS),
    "fx_fires": ("orders", FIRES),
    "fx_perimeters": ("supplier", PERIMETERS),
    "fx_burns": ("events", BURNS),
    "fx_boundary": ("nation", BOUNDARY),
    "fx_landed": ("events", LANDED),
    "fx_centres": ("supplier", CENTRES),
    "fx_payloads": ("customer", PAYLOADS),
    "fx_sites": ("orders", SITES),
    "fx_districts": ("part", DISTRICTS),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; a projection of its base table, so only needed columns are read."""
    base, columns = COLUMNS[name]
    return table(spark, sf_dir, base).selectExpr(
        *[f"{expression} AS {column}" for column, expression in columns.items()]
    )


def raw_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras as nested feed records."""
    return derived(spark, sf_dir, "fx_cameras").select(
        "cam_key",
        "name",
        "source",
        F.struct(F.col("pan").cast("string").alias("pan")).alias("position"),
        F.struct(F.col("image_url").alias("url")).alias("image"),
        F.struct(
            F.col("site_id").cast("string").alias("id"), "state", "latitude", "longitude", "county"
        ).alias("site"),
    )


def camera_payloads(spark: SparkSession, sf_dir: str, records: int = 100) -> DataFrame:
    """Cameras as feed payloads: JSON arrays of up to ``records`` records."""
    record = F.struct("name", "source", "position", "image", "site")
    return (
        raw_cameras(spark, sf_dir)
        .groupBy(F.floor(F.col("cam_key") / records).alias("feed"))
        .agg(F.to_json(F.collect_list(record)).alias("payload"))
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeter polygons as arrays of rings."""

    def place(at):
        return F.array(
            *[
                (F.col(centre) + F.col("k") * at[axis]).cast("double") / 1000
                for axis, centre in enumerate(("cx", "cy"))
            ]
        )

    outlines = F.array(
        *[F.array(*[F.array(F.lit(dx), F.lit(dy)) for dx, dy in ring]) for ring in (OUTER, HOLE)]
    )
    rings = F.transform(outlines, lambda ring: F.transform(ring, place)).alias("rings")
    return derived(spark, sf_dir, "fx_centres").select("geom_id", rings)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge table of the perimeter polygons."""
    return polygon_edges(polygons(spark, sf_dir))


def district_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge table of polygons that share their borders."""
    grid = ", ".join(f"{text} AS {name}" for name, text in DISTRICT_GRID.items())
    place = ", ".join(re.sub(r"\b(gx|gy)\b", r"at.\1", text) for text in DISTRICT_PLACE.values())
    steps = f"transform(sequence(0, {DISTRICT_STEPS}), t -> struct({grid}))"
    ring = f"transform({steps}, at -> array({place}))"
    # A small table that makes many edges: dealt to all tasks first.
    districts = derived(spark, sf_dir, "fx_districts").repartition(spark.sparkContext.defaultParallelism, "geom_id")
    return polygon_edges(districts.selectExpr("geom_id", f"array({ring}) AS rings"))


def polygon_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeter polygons as GeoJSON text, every third one as a MultiPolygon."""
    shapes = polygons(spark, sf_dir)
    single = F.to_json(
        F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    )
    multi = F.to_json(
        F.struct(F.lit("MultiPolygon").alias("type"), F.array("rings").alias("coordinates"))
    )
    return shapes.select(
        "geom_id", F.when(F.col("geom_id") % 3 == 0, multi).otherwise(single).alias("geometry")
    )


def burn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned burns with GeoJSON geometry; odd ids carry quoted coordinates."""
    position = F.array("lon", "lat")
    quoted = F.array(F.col("lon").cast("string"), F.col("lat").cast("string"))

    def geometry(kind: str, coordinates):
        return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))

    text = (
        F.when(F.col("geom_type") == "Point", geometry("Point", position))
        .when(F.col("geom_type") == "MultiPoint", geometry("MultiPoint", F.array(quoted, quoted)))
        .otherwise(geometry("Polygon", F.array(F.array(position, position, position, position))))
    )
    return derived(spark, sf_dir, "fx_burns").withColumn("geometry", text).drop("lon", "lat")


def landed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four paged layers as landed response pages, with numbers sent as numbers."""

    def pages(layer: str, rows: DataFrame, size: int) -> DataFrame:
        feature = F.concat(
            F.lit('{"type":"Feature","id":'),
            F.col("key").cast("string"),
            F.lit(',"geometry":'),
            F.col("geometry"),
            F.lit(',"properties":'),
            F.col("sent"),
            F.lit("}"),
        )
        in_order = F.array_sort(F.collect_list(F.struct("rank", feature.alias("text"))))
        more = F.when(F.count("*") == size, "true").otherwise("false")
        body = F.concat(
            F.lit('{"features":['),
            F.array_join(F.transform(in_order, lambda item: item["text"]), ","),
            F.lit('],"exceededTransferLimit":'),
            more,
            F.lit("}"),
        )
        filled = (
            assign_pages(rows, "key", size)
            .groupBy("page_no")
            .agg(F.min("rank").alias("result_offset"), body.alias("body"))
        )
        # A full last page is followed by an empty one.
        end = rows.agg(F.count("*").alias("result_offset")).where(F.col("result_offset") % size == 0)
        empty = end.withColumn("body", F.lit('{"features":[]}'))
        return (
            filled.select("result_offset", "body")
            .unionByName(empty)
            .select(F.lit(layer).alias("layer"), "result_offset", F.lit(200).alias("http_status"), "body")
        )

    def sent(fields: tuple[str, ...], *values: str) -> Column:
        named = [F.expr(value).alias(field) for field, value in zip(fields, values)]
        return F.to_json(F.struct(*named))

    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    fires = derived(spark, sf_dir, "fx_fires").select(
        F.col("objectid").alias("key"),
        point.alias("geometry"),
        sent(
            fixed.FIRE_FIELDS,
            "incident_name",
            "try_cast(incident_size AS DOUBLE)",
            "percent_contained",
            "poo_county",
            "poo_state",
        ).alias("sent"),
    )
    perimeters = derived(spark, sf_dir, "fx_perimeters").join(polygon_geojson(spark, sf_dir), "geom_id")
    perimeters = perimeters.select(
        F.col("geom_id").alias("key"),
        "geometry",
        sent(
            fixed.PERIMETER_FIELDS,
            "poly_incident_name",
            "attr_incident_name",
            "try_cast(poly_gisacres AS DOUBLE)",
            "attr_percent_contained",
            "attr_poo_county",
            "attr_poo_state",
        ).alias("sent"),
    )
    by_number = sent(fixed.BURN_FIELDS, "name", "start_ms", "watchduty_url", "acreage")
    by_text = sent(fixed.BURN_FIELDS, "name", "start_text", "watchduty_url", "acreage")
    burns = burn_features(spark, sf_dir).select(
        F.col("event_id").alias("key"),
        "geometry",
        F.when(F.col("start_ms").isNotNull(), by_number).otherwise(by_text).alias("sent"),
    )
    # A square per state; every second is a set of one, the first two are points.
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    ring = ",".join(f"array(oid - 120 + {dx}, 44 + {dy})" for dx, dy in corners)
    square = F.expr(f"to_json(array(array({ring})))")
    coordinates = (
        F.when(F.col("geom_type") == "Point", F.lit("[-120,44]"))
        .when(F.col("geom_type") == "Polygon", square)
        .otherwise(F.concat(F.lit("["), square, F.lit("]")))
    )
    shape = F.concat(F.lit('{"type":"'), "geom_type", F.lit('","coordinates":'), coordinates, F.lit("}"))
    boundary = derived(spark, sf_dir, "fx_boundary").select(
        F.col("oid").alias("key"),
        shape.alias("geometry"),
        sent(fixed.BOUNDARY_FIELDS, "state_fips", "geoid").alias("sent"),
    )
    return (
        pages("fires", fires, fixed.PAGE_SIZE)
        .unionByName(pages("perimeters", perimeters, fixed.PERIMETER_PAGE_SIZE))
        .unionByName(pages("burns", burns, fixed.PAGE_SIZE))
        .unionByName(pages("boundary", boundary, fixed.PAGE_SIZE))
    )


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their rank and page within their type, which serves as the layer."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("layer"), "event_id", "value"
    )
    return assign_pages(events, "event_id", EVENT_PAGE_SIZE, by=["layer"])


# Where the page set of layer ``view`` is stuck.
STUCK_AT = 2 * EVENT_PAGE_SIZE


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lengths and flags: ``error`` lacks a page, ``view`` is stuck, ``click`` has a stray end."""
    ranked = event_pages(spark, sf_dir)
    pages = (
        ranked.groupBy("layer", "page_no")
        .agg(F.min("rank").alias("result_offset"), F.count("*").alias("page_len"))
        .withColumn("exceeded", F.col("page_len") == EVENT_PAGE_SIZE)
        .where("NOT (layer = 'error' AND page_no = 1) AND NOT (layer = 'view' AND page_no = 2)")
    )
    at = F.when(F.col("layer") == "view", STUCK_AT).otherwise(F.count("*")).cast("bigint")
    empty = (
        table(spark, sf_dir, "events")
        .where("event_type IN ('view', 'click')")
        .groupBy(F.col("event_type").alias("layer"))
        .agg(at.alias("result_offset"))
        .select(
            "layer",
            F.lit(999999).cast("bigint").alias("page_no"),
            "result_offset",
            F.lit(0).cast("bigint").alias("page_len"),
            F.lit(True).alias("exceeded"),
        )
    )
    return pages.unionByName(empty)


def broken_event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed event pages of which ``error`` lacks one and ``view`` is stuck."""
    whole = landed_event_pages(spark, sf_dir)
    lost = (F.col("layer") == "error") & (F.col("result_offset") == EVENT_PAGE_SIZE)
    stuck = (F.col("layer") == "view") & (F.col("result_offset") == STUCK_AT)
    body = F.when(stuck, F.lit('{"features":[],"exceededTransferLimit":true}'))
    return whole.where(~lost).withColumn("body", F.coalesce(body, F.col("body")))


def landed_event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed response pages with JSON bodies; a page holds at most 50 features."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col("event_id").alias("id"),
        F.struct("event_id", "value").alias("properties"),
    )
    in_order = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", feature.alias("feature")))),
        lambda item: item["feature"],
    )
    body = F.to_json(
        F.struct(
            F.lit("FeatureCollection").alias("type"),
            in_order.alias("features"),
            (F.count("*") == EVENT_PAGE_SIZE).alias("exceededTransferLimit"),
        )
    )
    return (
        event_pages(spark, sf_dir)
        .groupBy("layer", "page_no")
        .agg(F.min("rank").alias("result_offset"), body.alias("body"))
        .select("layer", "result_offset", F.lit(200).alias("http_status"), "body")
    )
