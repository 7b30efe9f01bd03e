from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from embergrid.llm import line_dedup
from tests.llm.data import CLASHING, awkward_rows, documents


def key_of(line: str) -> str:
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def expected(rows, min_docs, min_chars=1):
    lines = [(row[1] or "").split("\n") for row in rows]
    found = Counter(key for one in lines for key in {key_of(line) for line in one})
    frequent = {key for key, n in found.items() if n >= min_docs and len(key) >= min_chars}
    result = Counter()
    for row, one in zip(rows, lines):
        kept = [line for line in one if key_of(line) not in frequent]
        result[row[0], len(one), len(one) - len(kept), "\n".join(kept)] += 1
    return result


def row(number, text):
    return (number, text, "en", "src0", 5) + CLASHING


def line_rows():
    rng = random.Random(5)
    common = ["Menu", "  menu\t", "MENU\r", "ÄÖ", "äö", "  x", "", " ", "Total: 1"]
    rows = []
    for number in range(60):
        own = [f"line {number} {place}" for place in range(rng.randrange(4))]
        lines = own + rng.choices(common, k=rng.randrange(5))
        rng.shuffle(lines)
        rows.append(row(number, "\n".join(lines)))
    rows += [row(None, "menu\nx"), row(3, "other"), rows[0], rows[0], row(70, "\n\n\n"), row(71, "a\n" * 3000)]
    return rows + awkward_rows()


@pytest.mark.parametrize("min_docs, min_chars", [(2, 1), (10, 1), (12, 5)])
@pytest.mark.parametrize("head_least", [0, 1_000])
def test_lines_against_plain_counts(spark, min_docs, min_chars, head_least):
    rows = line_rows()
    result = line_dedup.drop_frequent_lines(
        documents(spark, rows), min_docs=min_docs, min_chars=min_chars, shard_keys=16, head_least=head_least
    )
    assert result.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert Counter(map(tuple, result.collect())) == expected(rows, min_docs, min_chars)


def test_empty_table(spark):
    assert line_dedup.drop_frequent_lines(documents(spark, [])).collect() == []


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 50_000])
def test_table_numbers_keys_without_gaps(size):
    rng = np.random.default_rng(size)
    keys = np.unique(rng.integers(0, 2**63, (size, 2), dtype=np.uint64), axis=0)
    counts = rng.integers(1, 1_000, len(keys))
    table = line_dedup.LineTable(keys, counts, 255)
    if size:
        assert sorted(table.numbers(keys).tolist()) == list(range(len(keys)))
    assert (table.counts_of(keys) == np.minimum(counts, 255)).all()
    unknown = rng.integers(0, 2**63, (10_000, 2), dtype=np.uint64)
    assert table.counts_of(unknown).sum() == 0


def test_table_keeps_keys_that_no_level_places(monkeypatch):
    monkeypatch.setattr(line_dedup, "_LEVELS", 1)
    keys = np.random.default_rng(1).integers(0, 2**63, (500, 2), dtype=np.uint64)
    table = line_dedup.LineTable(keys, np.arange(500), 1_000)
    assert table.tail and (table.counts_of(keys) == np.arange(500)).all()
