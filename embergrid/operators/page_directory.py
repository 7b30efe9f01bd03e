"""A directory from rank to key range, so that a page is a range filter which reaches the scan (O2).

Ranking a table to cut one page out of it reads and shuffles all of its rows. The directory holds, for
about every ``bucket_rows`` keys in order, the first and the last key and how many keys come before. The
keys at the two ends of a page are then looked up in at most two buckets, and the page is all rows
between them: no rank, no window and no shuffle, and Parquet skips the row groups outside.

The directory is a small table; store it beside the data and give it to ``page_between`` for every page.
It belongs to one version of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

# Keys that a bucket should hold.
BUCKET_ROWS = 250_000

# Above this many buckets they grow instead, so that the shuffle of the keys stays manageable. A bucket
# is sorted by one task, which spills, so its size costs time only.
MAX_BUCKETS = 10_000


def page_directory(
    df: DataFrame, order: str, distinct: bool = False, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``bucket, first, last, missing, rows, start`` for the keys in ``order``, of any sortable type.

    ``missing`` counts NULL keys, which come first; ``first`` and ``last`` are those of the others, and
    NULL where a bucket has none. ``start`` is how many keys come before the bucket. ``distinct`` counts
    each key once, for tables with many rows per key. An empty table gives no buckets. Only the keys are
    shuffled, by range; a key is in one bucket. Planning runs a count and Spark's sample of the keys.
    """
    keys = _keys(df, order, distinct)
    return _buckets(keys, min(MAX_BUCKETS, max(1, -(-keys.count() // bucket_rows))))


def _buckets(keys: DataFrame, buckets: int) -> DataFrame:
    placed = keys.repartitionByRange(buckets, "key")
    sizes = placed.groupBy(F.spark_partition_id().alias("bucket")).agg(
        F.min("key").alias("first"),
        F.max("key").alias("last"),
        F.count_if(F.col("key").isNull()).alias("missing"),
        F.count("*").alias("rows"),
    )
    # One row per bucket.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("bigint"))


def page_between(
    df: DataFrame,
    order: str,
    directory: DataFrame,
    offset: int,
    limit: int | None = None,
    distinct: bool = False,
) -> DataFrame:
    """The rows of keys ``offset`` to ``offset + limit``, or to the end, by a directory of ``df``.

    ``order`` must be unique, or the directory ``distinct``: then the page is ``limit`` keys with all
    their rows. A page past the end is empty. Planning reads the directory and the keys of at most two
    buckets; two keys come back.
    """
    if limit is not None and limit <= 0:
        return df.where(F.lit(False))
    ends = _ends(offset, limit)
    holding = F.lit(False)
    for rank in ends:
        holding |= (F.col("start") <= rank) & (F.lit(rank) < F.col("start") + F.col("rows"))
    # At most two rows.
    found = directory.where(holding).orderBy("start").collect()
    if not found or found[0]["start"] > offset:
        return df.where(F.lit(False))
    return _between(df, order, _keys_at(_keys(df, order, distinct), found, ends), offset, limit)


def page_of(
    df: DataFrame,
    order: str,
    offset: int,
    limit: int | None = None,
    distinct: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``page_between`` by a directory made for this page alone; none is needed within one bucket."""
    keys = _keys(df, order, distinct)
    total = keys.count()
    if total > bucket_rows:
        directory = _buckets(keys, min(MAX_BUCKETS, -(-total // bucket_rows)))
        return page_between(df, order, directory, offset, limit, distinct)
    if offset >= total or (limit is not None and limit <= 0):
        return df.where(F.lit(False))
    return _between(df, order, _ranked(keys.withColumn("start", F.lit(0)), _ends(offset, limit)), offset, limit)


def _ends(offset: int, limit: int | None) -> list[int]:
    """Ranks of the first and the last key of a page; only the first of one without a limit."""
    return [offset] if limit is None else [offset, offset + limit - 1]


def _between(df: DataFrame, order: str, at: dict[int, object], offset: int, limit: int | None) -> DataFrame:
    ends = _ends(offset, limit)
    kind = df.schema[order].dataType
    key, wanted = F.col(f"`{order}`"), F.lit(True)
    if at[offset] is not None:
        wanted = key >= F.lit(at[offset]).cast(kind)
    if ends[-1] in at and limit is not None:
        last = at[ends[-1]]
        upper = key.isNull() if last is None else key <= F.lit(last).cast(kind)
        # NULL comes first: it is in the page exactly if the page starts with it.
        wanted = (wanted & upper) if at[offset] is not None else (key.isNull() | upper)
    return df.where(wanted)


def _keys(df: DataFrame, order: str, distinct: bool) -> DataFrame:
    keys = df.select(F.col(f"`{order}`").alias("key"))
    return keys.distinct() if distinct else keys


def _within(keys: DataFrame, bucket: Row) -> Column:
    kind = keys.schema["key"].dataType
    inside = F.lit(False)
    if bucket["first"] is not None:
        inside = F.col("key").between(F.lit(bucket["first"]).cast(kind), F.lit(bucket["last"]).cast(kind))
    return inside | F.col("key").isNull() if bucket["missing"] else inside


def _keys_at(keys: DataFrame, buckets: list[Row], ranks: list[int]) -> dict[int, object]:
    """Keys at the ranks that lie in the buckets."""
    start = F.lit(None).cast("bigint")
    for bucket in buckets:
        start = F.when(_within(keys, bucket), F.lit(bucket["start"])).otherwise(start)
    inside = F.lit(False)
    for bucket in buckets:
        inside |= _within(keys, bucket)
    return _ranked(keys.where(inside).withColumn("start", start), ranks)


def _ranked(near: DataFrame, ranks: list[int]) -> dict[int, object]:
    """Keys at ``ranks``, where ``start`` keys come before those with the same ``start``."""
    place = F.row_number().over(Window.partitionBy("start").orderBy("key")) - 1
    ranked = near.withColumn("rank", F.col("start") + place)
    return {row["rank"]: row["key"] for row in ranked.where(F.col("rank").isin(ranks)).collect()}
