"""Sharding by a lookup table that shards fill in turns (operator 3).

Every shard walks the slots of a prime-sized table in an order of its own (start and step from a
hash of its name). Shards take turns; in a turn a shard claims the next slot of its order that is
still free. The full table gives every shard its share, and a shard that leaves or joins moves few
other slots. Placing a row is one hash and one lookup in the broadcast table, whose size is the
``slots`` parameter whatever the data.

Cases: a null key is placed like the empty string; repeated keys go to one shard; an empty table
gives an empty result; a column called like one of the added ones is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.llm.common import read_table

# A prime at least a hundred times the shards keeps shares within about one percent of even.
SLOTS = 4099
SHARDS = tuple(f"shard-{number:02d}" for number in range(32))

# Hex digits of the digest in use: 60 bits stay positive in a signed 64-bit integer.
HASH_DIGITS = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HASH_DIGITS], 16)


def is_prime(number: int) -> bool:
    return number > 1 and all(number % d for d in range(2, int(number**0.5) + 1))


def fill_table(
    shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None
) -> list[int]:
    """Shard index of every slot.

    A shard takes as many turns in a round as its weight, 1 by default.
    """
    if not is_prime(slots):
        raise ValueError("slots must be prime, so that every step visits all slots")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    turns = [int((weights or {}).get(name, 1)) for name in shards]
    if len(shards) > slots or min(turns) < 0 or not any(turns):
        raise ValueError("too many shards for the slots, or no shard with a weight")
    place = [_hash(f"{name}/start") % slots for name in shards]
    step = [_hash(f"{name}/step") % (slots - 1) + 1 for name in shards]
    table = [-1] * slots
    free = slots
    while True:
        for index, count in enumerate(turns):
            for _ in range(count):
                while table[place[index]] >= 0:
                    place[index] = (place[index] + step[index]) % slots
                table[place[index]] = index
                free -= 1
                if not free:
                    return table


def key_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long") % slots


def table_frame(spark: SparkSession, shards: Sequence[str], table: Sequence[int]) -> DataFrame:
    """The lookup table with one row per slot."""
    rows = [(slot, shards[index]) for slot, index in enumerate(table)]
    schema = T.StructType(
        [T.StructField("slot", T.LongType()), T.StructField("shard", T.StringType())]
    )
    return spark.createDataFrame(rows, schema)


def place(
    df: DataFrame,
    key: str,
    shards: Sequence[str] = SHARDS,
    slots: int = SLOTS,
    weights: Mapping[str, int] | None = None,
) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row, without a shuffle."""
    lookup = table_frame(df.sparkSession, shards, fill_table(shards, slots, weights))
    return (
        df.drop("shard")
        .withColumn("slot", key_slot(F.col(key), slots))
        .join(F.broadcast(lookup), "slot")
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id")
    return place(documents, "doc_id").select("doc_id", "slot", "shard")


# Fills the same table by its own rule: one recursion step is one turn, which looks for the first
# free slot of the shard's whole order from its start.
ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i,
    ('0x' || substr(md5(printf('shard-%02d/start', i)), 1, {HASH_DIGITS}))::BIGINT % {SLOTS} AS start,
    ('0x' || substr(md5(printf('shard-%02d/step', i)), 1, {HASH_DIGITS}))::BIGINT % {SLOTS - 1} + 1 AS step
  FROM range({len(SHARDS)}) t(i)
),
turns(n, taken) AS (
  SELECT 0::BIGINT, list_transform(range({SLOTS}), lambda x: (-1)::BIGINT)
  UNION ALL
  SELECT n + 1, list_concat(list_concat(taken[1:slot], [n % {len(SHARDS)}]), taken[slot + 2:])
  FROM (
    SELECT n, taken, (start + step * list_filter(
      range({SLOTS}), lambda j: taken[(start + step * j) % {SLOTS} + 1] < 0)[1]) % {SLOTS} AS slot
    FROM turns JOIN shards ON shards.i = n % {len(SHARDS)}
    WHERE n < {SLOTS}
  )
),
filled AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest(taken) AS i FROM turns WHERE n = {SLOTS}
)
SELECT doc_id, slot, printf('shard-%02d', i) AS shard
FROM (
  SELECT doc_id,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HASH_DIGITS}))::BIGINT % {SLOTS} AS slot
  FROM documents
) JOIN filled USING (slot)
"""
