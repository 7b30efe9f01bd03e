"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than this part of all rows is hot.
HOT_SHARES = 512

# A side with more rows than this is shuffled, not broadcast. At about 100 bytes per row the
# default is some 100 MB of rows.
BROADCAST_ROWS = 1_000_000


def hot_keys(counts: DataFrame, total: int, n: str = "n", shares: int = HOT_SHARES) -> DataFrame:
    """Keys above ``1/shares`` of all rows, with the number of ``splits`` each needs.

    ``counts`` has the keys and their row count ``n``. If they add up to ``total``, at most
    ``shares`` keys can be hot, so the result is small enough to broadcast by construction.
    """
    limit = max(1, total // shares)
    splits = F.ceil(F.col(n) / limit).cast("int").alias("splits")
    return counts.where(F.col(n) > limit).withColumn("splits", splits).drop(n)


def join_split(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    hot: DataFrame,
    spread_by: Column,
    hot_by: list[str] | None = None,
) -> DataFrame:
    """Inner join with the hot keys split.

    Rows of a hot key on the ``many`` side are spread by hash over its splits, and the matching
    rows on the ``few`` side are copied once per split. Each pair still meets exactly once.
    ``few`` may bring a ``splits`` column of its own, which stays in the result. ``hot`` lists the keys,
    or those of them in ``hot_by``.
    """
    hot_by = hot_by or keys
    own = F.coalesce("hot_splits", F.lit(1))
    renamed = F.broadcast(hot.withColumnRenamed("splits", "hot_splits"))
    spread = (
        many.join(renamed, hot_by, "left")
        .withColumn("split", F.pmod(F.xxhash64(spread_by), own).cast("int"))
        .drop("hot_splits")
    )
    copies = (
        few.join(renamed, hot_by, "left")
        .withColumn("split", F.explode(F.sequence(F.lit(0), own - 1)))
        .drop("hot_splits")
    )
    return spread.join(copies.hint("merge"), [*keys, "split"]).drop("split")


def _null_safe(keys: list[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same &= F.col(f"_many.`{key}`").eqNullSafe(F.col(f"_few.`{key}`"))
    return same


def lookup_join(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``many`` that has a key in ``few``, with its columns; NULL keys are equal.

    ``few`` has one row per key. The planner broadcasts it when it knows it to be small enough in
    bytes. Otherwise both sides are shuffled, and partitions of ``many`` that one key fills are
    split while the query runs, since only rows of the other side are copied for that.
    """
    one, two = many.alias("_many"), few.alias("_few")
    joined = one.join(two, _null_safe(keys))
    own = [F.col(f"_many.`{name}`") for name in many.columns]
    added = [F.col(f"_few.`{name}`") for name in few.columns if name not in keys]
    return joined.select(*own, *added)
