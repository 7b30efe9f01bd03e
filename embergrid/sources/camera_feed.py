"""Camera feed: landed payloads, each one JSON array of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.functions.once import with_once
from embergrid.sources.json_ranges import CHUNK_BYTES, array_chunks

# Largest text that the JSON parser takes as one value.
PARSED_BYTES = 128 << 20
PAYLOAD_SIZE_ERROR = "payload too large for one value"

# Texts of a record, by their place in it.
RECORD_FIELDS = {
    "name": "$.name",
    "source": "$.source",
    "pan": "$.position.pan",
    "url": "$.image.url",
    "id": "$.site.id",
    "state": "$.site.state",
    "latitude": "$.site.latitude",
    "longitude": "$.site.longitude",
    "county": "$.site.county",
}


def _checked(payload: str) -> Column:
    """The payload as an array of VARIANT items, NULL when it is no JSON array and nothing else."""
    mark = F.xxhash64(payload).cast("string")
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(payload), F.lit(',"'), mark, F.lit('"]')))
    # As for pages: only one whole document leaves the mark as the second and last item.
    whole = (F.try_variant_get(wrapped, "$[1]", "string") == mark) & F.try_variant_get(
        wrapped, "$[2]", "variant"
    ).isNull()
    return F.when(whole, F.try_variant_get(wrapped, "$[0]", "array<variant>"))


def _too_large(payload: str) -> Column:
    return F.octet_length(payload) + 64 > PARSED_BYTES


def _record() -> Column:
    """The record of an object item; a part that is no object has no fields."""

    def part(place: str, *names: str) -> Column:
        fields = [F.try_variant_get("item", RECORD_FIELDS[name], "string").alias(name) for name in names]
        is_object = F.schema_of_variant(F.try_variant_get("item", place, "variant")).startswith("OBJECT")
        return F.when(is_object, F.struct(*fields))

    return F.struct(
        F.try_variant_get("item", RECORD_FIELDS["name"], "string").alias("name"),
        F.try_variant_get("item", RECORD_FIELDS["source"], "string").alias("source"),
        part("$.position", "pan").alias("position"),
        part("$.image", "url").alias("image"),
        part("$.site", "id", "state", "latitude", "longitude", "county").alias("site"),
    )


def camera_records(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per camera record; a payload that is no JSON array is an error.

    Items that are no objects are skipped. A payload too large for one value has an error of its own:
    landed as a file, it is read by ``read_camera_feed``.
    """
    error = F.raise_error(
        F.when(_too_large(payload), F.lit(PAYLOAD_SIZE_ERROR)).otherwise(F.lit(fixed.CAMERA_PAYLOAD_ERROR))
    )
    parsed = with_once(payloads.select(payload), items=_checked(payload))
    items = F.when(F.col("items").isNotNull(), F.col("items")).otherwise(error)
    rows = parsed.select(F.explode(items).alias("item"))
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    return with_once(rows.where(is_object), record=_record()).select("record.*")


def read_camera_feed(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Camera records of all landed payload files under ``path``, one payload per file of any size."""
    return camera_records(array_chunks(spark, path, chunk_bytes).select("chunk"), "chunk")


def payload_shapes(payloads: DataFrame, payload: str, *keep: str) -> DataFrame:
    """``keep`` columns with ``ok`` and ``error``: the shape check of each payload."""
    ok = F.coalesce(_checked(payload).isNotNull(), F.lit(False))
    checked = with_once(payloads.select(*keep, payload), ok=ok, large=_too_large(payload))
    error = F.when(F.col("large"), PAYLOAD_SIZE_ERROR).otherwise(fixed.CAMERA_PAYLOAD_ERROR)
    return checked.select(*keep, "ok", F.when(~F.col("ok"), error).alias("error"))


def feed_shapes(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per landed file with its shape check, to set bad payloads aside."""
    chunks = payload_shapes(array_chunks(spark, path, chunk_bytes), "chunk", "file")
    return chunks.groupBy("file").agg(F.bool_and("ok").alias("ok"), F.min("error").alias("error"))
