"""Large JSON arrays read by byte ranges: one file in many tasks, of any size.

A text scan cut at ``}`` gives each task a byte range of a file as fragments, whatever the lines are.
What a fragment means depends on all before it: whether it starts inside a string, and how deep. Two
sums say so. Each range counts its quotes, and its depth for both cases; the ranges of a file are then
combined in order, which tells every range its start, and running sums inside a range do the rest.

An object that ends at depth one ends an item of the array. There a file is cut into chunks of about
``CHUNK_BYTES``, each made a small JSON array of its own, so that the usual parser, which takes values
up to a limit, judges every piece. A file is one array exactly if each of its chunks is.

Texts move once, by file and range. Files of no bytes are not listed by Spark and give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

_RANGE = ["file", "range"]


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, range, place, text``: texts up to each ``}``, without it, in file order by place."""
    rows = spark.read.text(path, lineSep="}")
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("text"),
        F.regexp_replace("value", r"(?s)\\.", "").alias("plain"),
    )


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _rise(plain: Column) -> Column:
    """Depth gained by text without escapes that starts outside strings, up to the ``}`` behind it."""
    outside = F.regexp_replace(plain, r'"[^"]*(?:"|\z)', "")
    closed = F.when(_count(plain, '"') % 2 == 0, 1).otherwise(0)
    return _count(outside, "{[") - _count(outside, "}]") - closed


def _states(fragments: DataFrame) -> DataFrame:
    """Adds ``odd``, whether the range's quotes before the fragment are odd, and both rises."""
    before = Window.partitionBy(*_RANGE).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.col("plain")
    quotes = _count(plain, '"')
    odd = F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2 == 1
    return fragments.select(
        *_RANGE,
        "place",
        "text",
        quotes.alias("quotes"),
        odd.alias("odd"),
        _rise(plain).alias("outside"),
        _rise(F.concat(F.lit('"'), plain)).alias("inside"),
    )


def _starts(states: DataFrame) -> DataFrame:
    """``in_string, depth, last_place`` of each range's start, from the ranges before it."""
    rise = F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))
    other = F.when(F.col("odd"), F.col("outside")).otherwise(F.col("inside"))
    ranges = states.groupBy(*_RANGE).agg(
        F.sum("quotes").alias("quotes"),
        F.sum(rise).alias("from_outside"),
        F.sum(other).alias("from_inside"),
        F.max("place").alias("last_place"),
    )
    # One row per range of a file.
    in_order = Window.partitionBy("file").orderBy("range")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    in_string = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    gained = F.when(F.col("in_string"), F.col("from_inside")).otherwise(F.col("from_outside"))
    return (
        ranges.withColumn("in_string", in_string)
        .withColumn("depth", F.coalesce(F.sum(gained).over(before), F.lit(0)))
        .withColumn("final", F.lead("range").over(in_order).isNull())
        .select(*_RANGE, "in_string", "depth", "last_place", "final")
    )


def _bordered(states: DataFrame, chunk_bytes: int) -> DataFrame:
    """Fragments with the chunk of their range that they belong to; null before the first border."""
    within = Window.partitionBy(*_RANGE).orderBy("place")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = states.join(_starts(states).hint("merge"), _RANGE)
    starts_inside = F.col("odd") != F.col("in_string")
    rise = F.when(starts_inside, F.col("inside")).otherwise(F.col("outside"))
    ends_outside = starts_inside == (F.col("quotes") % 2 == 1)
    last = F.col("final") & (F.col("place") == F.col("last_place"))
    border = ends_outside & (F.col("depth") + F.sum(rise).over(upto) == 1) & ~last
    so_far = F.sum(F.octet_length("text") + 1).over(upto)
    at = F.floor(so_far / chunk_bytes)
    marked = placed.select(*_RANGE, "place", "text", last.alias("last"), F.when(border, at).alias("border"))
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("own", F.max("border").over(before))


def array_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``file, chunk``: each file as small JSON arrays of its items, in no order.

    ``chunk`` is null where a file goes on in a way that no array does. What is wrong inside a chunk
    is left to its parser.
    """
    rows = _bordered(_states(_fragments(spark, path)), chunk_bytes)
    # A chunk that a range begins with belongs to the last border of an earlier range.
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inherited = (
        rows.groupBy(*_RANGE)
        .agg(F.max("border").alias("border"))
        .withColumn("key", F.when(F.col("border").isNotNull(), F.struct("range", "border")))
        .withColumn("inherited", F.last("key", ignorenulls=True).over(before))
        .select(*_RANGE, "inherited")
    )
    own = F.when(F.col("own").isNotNull(), F.struct("range", F.col("own").alias("border")))
    keyed = rows.join(inherited.hint("merge"), _RANGE).withColumn("key", F.coalesce(own, "inherited"))
    parts = F.sort_array(F.collect_list(F.struct("range", "place", "text"))).alias("parts")
    chunks = keyed.groupBy("file", "key").agg(parts, F.bool_or("last").alias("tail"))
    text = F.concat(F.array_join("parts.text", "}"), F.when(F.col("tail"), "").otherwise("}"))
    follows, ends = text.rlike(r"^\s*,"), text.rlike(r"^\s*\]")
    rest = F.regexp_replace(text, r"^\s*,", "")
    # After a comma there is an item, so a closing bracket does not come next.
    goes_on = F.when(follows & ~rest.rlike(r"^\s*\]"), F.concat(F.lit("["), rest))
    goes_on = goes_on.when(F.col("tail") & ends, F.concat(F.lit("["), text))
    opened = F.when(F.col("key").isNull(), text).otherwise(goes_on)
    closing = F.when(F.col("tail"), "").otherwise("]")
    return chunks.select("file", F.concat(opened, closing).alias("chunk"))
