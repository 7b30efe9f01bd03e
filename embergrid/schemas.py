"""Schemas of the landed input and of the layer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LANDED_PAGE = "layer STRING, result_offset BIGINT, http_status INT, body STRING"

PAGE_FACTS = (
    "layer STRING, result_offset BIGINT, http_status INT, outcome STRING, retryable BOOLEAN, "
    "message STRING, page_len BIGINT, exceeded BOOLEAN"
)

EDGES = "geom_id BIGINT, ring INT, seq INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"

# ``sent`` holds the properties as they were sent, with their types.
LAYERS = {
    "cameras": (
        "id STRING, name STRING, pan STRING, image STRING, state STRING, county STRING, "
        "lon DOUBLE, lat DOUBLE"
    ),
    "fires": (
        "feature_id STRING, incident_name STRING, incident_size STRING, "
        "percent_contained STRING, poo_county STRING, poo_state STRING, "
        "incident_type_category STRING, lon DOUBLE, lat DOUBLE, acres DOUBLE, sent VARIANT"
    ),
    "perimeters": (
        "feature_id STRING, poly_incident_name STRING, attr_incident_name STRING, "
        "poly_gisacres STRING, attr_percent_contained STRING, attr_poo_county STRING, "
        "attr_poo_state STRING, attr_incident_type_category STRING, geom_type STRING, "
        "geometry STRING, sent VARIANT"
    ),
    "burns": (
        "feature_id STRING, name STRING, start_ms BIGINT, start_text STRING, "
        "watchduty_url STRING, acreage STRING, lon DOUBLE, lat DOUBLE, sent VARIANT"
    ),
    "boundary": (
        "oid BIGINT, state_fips STRING, geoid STRING, geom_type STRING, geometry STRING, "
        "kind STRING, draw_order INT, sent VARIANT"
    ),
}
FEATURES = (
    "layer STRING, feature_id STRING, geom_type STRING, lon DOUBLE, lat DOUBLE, "
    "geometry STRING, properties STRING, sent VARIANT"
)
LOAD_STATUS = "layer STRING, ok BOOLEAN, error STRING, rows BIGINT"
COMMITS = "layer STRING, seq BIGINT, version STRING, ok BOOLEAN, error STRING, rows BIGINT"


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    """A table with the given schema and no rows."""
    return spark.createDataFrame([], schema)
