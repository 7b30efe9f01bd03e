from __future__ import annotations

from collections import Counter

import pytest

from embergrid.llm import sharding
from tests.llm.data import documents


def by_preference(shards, slots, weights=None):
    """Shards claim the next free slot of a preference list written out in full."""
    lists = []
    for name in shards:
        start, step = sharding._hash(f"{name}/start") % slots, sharding._hash(f"{name}/step") % (slots - 1) + 1
        lists.append([(start + step * k) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for index, name in enumerate(shards):
            for _ in range((weights or {}).get(name, 1)):
                free = [slot for slot in lists[index] if slot not in owner]
                if free:
                    owner[free[0]] = index
    return [owner[slot] for slot in range(slots)]


def test_table_equals_turns_written_out():
    shards = ("a", "b", "c")
    assert sharding.fill_table(shards, 101) == by_preference(shards, 101)
    assert sharding.fill_table(shards, 101, {"a": 3}) == by_preference(shards, 101, {"a": 3})


def test_shares_are_even_and_few_slots_move():
    table = sharding.fill_table(sharding.SHARDS)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(one != two for one, two in zip(table, fewer) if one != len(sharding.SHARDS) - 1)
    assert moved < 0.2 * len(table)


def test_bad_tables():
    for shards, slots in ((("a",), 100), ((), 101), (("a", "a"), 101)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, slots)


def test_awkward_rows(spark):
    df = documents(spark).withColumnRenamed("key", "slot").withColumnRenamed("a", "shard")
    placed = sharding.place(df, "doc_id")
    rows = placed.collect()
    assert len(rows) == df.count() and sorted(placed.columns) == sorted(df.columns)
    assert all(row["shard"] in sharding.SHARDS for row in rows)
    by_id = {}
    for row in rows:
        assert by_id.setdefault(row["doc_id"], row["shard"]) == row["shard"]
    assert sharding.place(documents(spark, []), "doc_id").collect() == []
