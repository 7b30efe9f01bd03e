from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from embergrid.llm import exact_dedup
from tests.llm.data import awkward_rows, documents


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(row[1] or "").encode().lower()].append(row[0])
    found = Counter()
    for text, ids in groups.items():
        keep = max((number for number in ids if number is not None), default=None)
        sha = hashlib.sha256(text).hexdigest()
        first = True
        for number in ids:
            kept = number == keep and first
            first = first and not kept
            found[number, keep, len(ids), kept, sha] += 1
    return found


def test_awkward_rows_with_normal_and_colliding_keys(spark):
    rows = awkward_rows()
    for bits in (63, 2):
        result = exact_dedup.exact_dedup(documents(spark), key_bits=bits, bucket_rows=4)
        got = Counter(
            (row["doc_id"], row["keep_id"], row["group_size"], row["kept"], row["text_sha256"])
            for row in result.collect()
        )
        assert got == expected(rows)


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).collect() == []


def test_directory_doubles_only_where_needed():
    # Four leading bits; one bucket holds nearly all rows.
    counts = {0b0000: 50, 0b0001: 40, 0b1000: 3, 0b1111: 3}
    buckets = exact_dedup.build_directory(counts, 4, 10)
    assert (1, 1) in buckets and (4, 0) in buckets and (4, 1) in buckets
    slots = exact_dedup.directory_slots(buckets, 4)
    assert len(slots) == 16 and slots == sorted(slots)
    assert len(set(slots[8:])) == 1 and slots[0] != slots[1]
