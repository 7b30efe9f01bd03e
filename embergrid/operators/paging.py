"""Paging: cut a table into pages, and prove that landed pages are a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.operators.page_directory import BUCKET_ROWS, page_of

# Rows looked at per bucket when choosing cuts; a hundred keep buckets within about a third of even.
SAMPLES_PER_BUCKET = 100


def rank_rows(
    df: DataFrame, order: str, by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Adds ``rank``, the 0-based place in ``order`` within each ``by`` group.

    A window over a whole group would put a hot group in one task. Instead rows are cut into
    buckets by value of ``order``; the rank is the size of the group's earlier buckets plus the
    place in the own bucket. No window then holds much more than ``bucket_rows`` rows.

    A sample only chooses where to cut: any cuts give the same ranks. The cuts are driver values,
    so a recomputed task cuts the same way. ``order`` must be a number, unique within a group; NULL
    comes first, and NULL groups are a group. Planning runs a count and a sample of ``df``.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    # At least one bucket per task; the cuts are one double per bucket.
    buckets = max(4 * partitions, -(-total // bucket_rows))
    cuts = _cuts(df, order, buckets, total)
    bucketed = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="_order",
        outputCol="_bucket",
        handleInvalid="keep",
    ).transform(df.withColumn("_order", F.col(order).cast("double")))
    # NULL has a bucket of its own before all others.
    number = F.when(F.col("_order").isNull(), -1).otherwise(F.col("_bucket").cast("int"))
    bucketed = bucketed.withColumn("_bucket", number)

    keys = [*by, "_bucket"]
    sizes = bucketed.groupBy(*keys).agg(F.count("*").alias("_size"))
    # At most one row per group and bucket.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    placed = bucketed.withColumn("_place", place).alias("_rows")
    same = F.lit(True)
    for key in keys:
        same &= F.col(f"_rows.`{key}`").eqNullSafe(F.col(f"_starts.`{key}`"))
    # The few starts move to the rows.
    joined = placed.join(starts.alias("_starts"), same)
    rank = (F.col("_starts._start") + F.col("_rows._place")).cast("bigint").alias("rank")
    return joined.select(*[F.col(f"_rows.`{name}`") for name in df.columns], rank)


def _cuts(df: DataFrame, order: str, buckets: int, total: int) -> list[float]:
    """Values that cut the rows into about even buckets: one double per bucket."""
    wanted = SAMPLES_PER_BUCKET * buckets
    keys = df.select(order)
    if total > wanted:
        keys = keys.sample(fraction=wanted / total, seed=0)
    shares = [index / buckets for index in range(1, buckets)]
    found = keys.agg(F.percentile_approx(order, shares, 10 * buckets)).first()[0] or []
    return sorted({float(cut) for cut in found}) or [0.0]


def page_slice(
    df: DataFrame,
    order: str,
    offset: int,
    limit: int | None = fixed.PAGE_SIZE,
    distinct: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One page in stable id order, or all rows from ``offset`` on (O1, O2).

    The page is a filter between its first and its last key, which a directory of the keys gives; see
    ``page_directory``, also for many pages of one table. A late page costs no more than an early one
    and no task holds the rows before it. ``order`` must be unique; with ``distinct`` the page is
    ``limit`` keys with all their rows. Rows come in no order of their own; sort by ``order``.
    """
    return page_of(df, order, offset, limit, distinct, bucket_rows)


def assign_pages(
    df: DataFrame, order: str, page_size: int = fixed.PAGE_SIZE, by: Sequence[str] = ()
) -> DataFrame:
    """Adds ``rank`` and ``page_no``: all pages of the table at once (O2)."""
    ranked = rank_rows(df, order, by)
    return ranked.withColumn("page_no", F.floor(F.col("rank") / page_size).cast("bigint"))


def page_status(pages: DataFrame, page_size: int = fixed.PAGE_SIZE) -> DataFrame:
    """Status of each layer's page set.

    Input: ``layer, result_offset, page_len, exceeded``. The scan starts at offset 0, each next
    offset is the sum of the lengths so far, and it stops at the first page that is unflagged and
    shorter than ``page_size``.

    * ``not_advanced``: a flagged page before the stop is empty, so the scan could not go on;
    * ``gap``: a page up to the stop does not start where the pages before it end, or two filled
      pages start at one offset;
    * ``complete``: the pages run from 0 to a stop page;
    * ``unfinished``: no gap, but no stop page either.

    Rather than a running sum, which would order a whole layer in one task, every page gives its
    start and its end. Pages tile the range exactly when each offset has as many ends as starts
    (offset 0 having one end of its own), so two aggregations with map-side combine are enough:
    per ``(layer, offset)``, then per layer.
    """
    filled = F.col("page_len") > 0
    stop = ~F.col("exceeded") & (F.col("page_len") < page_size)
    stuck = F.col("exceeded") & ~filled
    one = filled.cast("int")
    start = F.struct(
        F.col("result_offset").alias("at"),
        one.alias("starts"),
        F.lit(0).alias("ends"),
        stop.alias("stop"),
        (stop & ~filled).alias("empty_stop"),
        stuck.alias("stuck"),
        F.lit(1).alias("pages"),
    )
    end = F.struct(
        (F.col("result_offset") + F.col("page_len")).alias("at"),
        F.lit(0).alias("starts"),
        one.alias("ends"),
        F.lit(False).alias("stop"),
        F.lit(False).alias("empty_stop"),
        F.lit(False).alias("stuck"),
        F.lit(0).alias("pages"),
    )
    marks = pages.select("layer", F.inline(F.array(start, end)))
    offsets = marks.groupBy("layer", "at").agg(
        F.sum("starts").alias("starts"),
        (F.sum("ends") + F.when(F.col("at") == 0, 1).otherwise(0)).alias("ends"),
        F.bool_or("stop").alias("stop"),
        F.bool_or("empty_stop").alias("empty_stop"),
        F.bool_or("stuck").alias("stuck"),
        F.sum("pages").alias("pages"),
    )
    # An empty stop page has no end of its own; it must sit where another page ends.
    meets = F.when(F.col("empty_stop"), F.col("ends") == 1).otherwise(
        F.col("starts") == F.col("ends")
    )
    layers = offsets.groupBy("layer").agg(
        F.min(F.when(~meets, F.col("at"))).alias("break_at"),
        F.min(F.when(F.col("stop"), F.col("at"))).alias("stop_at"),
        F.max("at").alias("end_at"),
        F.min(F.when(F.col("stuck"), F.col("at"))).alias("stuck_at"),
        F.sum("pages").alias("pages"),
    )
    # A scan never asks for what lies after its stop page.
    stuck = F.coalesce(F.col("stuck_at") <= F.col("stop_at"), F.col("stuck_at").isNotNull())
    # Without a stop page the last end is open and no break.
    broken = F.coalesce(
        F.col("break_at") <= F.col("stop_at"), F.col("break_at") < F.col("end_at"), F.lit(False)
    )
    return layers.select(
        "layer",
        F.when(stuck, "not_advanced")
        .when(broken, "gap")
        .when(F.col("stop_at").isNotNull(), "complete")
        .otherwise("unfinished")
        .alias("status"),
        "pages",
        "stop_at",
    )
