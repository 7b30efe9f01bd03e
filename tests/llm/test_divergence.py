from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from embergrid.llm import divergence
from tests.llm.data import CLASHING, awkward_rows, documents

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def expected(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    result = set()
    for lang, sources in groups.items():
        kept = [term for term, n in docs[lang].items() if n >= min_docs]

        def chances(count):
            size = sum(count[term] for term in kept) + len(kept)
            return {term: 1 + 10**9 * (count[term] + 1) // size for term in kept}

        whole = chances(sum((counts[lang, source] for source in sources), Counter()))
        by_source = {source: chances(counts[lang, source]) for source in sources}
        for source in sources:
            p = by_source[source]
            pairs = [
                (sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other)
                for other, q in by_source.items()
                if other != source
            ]
            terms = [
                ((p[t] - whole[t]) ** 2 // whole[t], t)
                for t in kept
                if counts[lang, source][t] and p[t] > whole[t]
            ]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda one: (-one[0], one[1].encode()))
                for rank, (value, item) in enumerate(found[:limit], 1):
                    result.add((lang, source, part, item, value, rank))
    return result


def term_rows():
    rng = random.Random(9)
    words = ["a", "Bc", "the", "word", "seven77", "eightbyt", "ninebytes", "sixteenbytesword", "seventeenbytesXYZ"]
    words += ["l" * 33, "L" * 64, "m" * 65, "é", "Ünïcödé", "日本語" * 9, "x" * 3000, "a b", "🙂"]
    rows = []
    for number in range(80):
        text = rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(words, k=rng.randrange(30)))
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "", None])
        rows.append((number, text, lang, source, 5) + CLASHING)
    rows += [(99, "word", "xx", "one", 1) + CLASHING, (98, None, "yy", "one", 1) + CLASHING]
    rows += [(97, "", "yy", "two", 1) + CLASHING, rows[0], rows[0], (None, "word", "en", "s9", 1) + CLASHING]
    return rows + awkward_rows()


@pytest.mark.parametrize("held, cells", [(1_000_000, 4_000_000), (10, 5)])
def test_audit_against_plain_python(spark, monkeypatch, held, cells):
    monkeypatch.setattr(divergence, "HELD_RUNS", held)
    monkeypatch.setattr(divergence, "HELD_CELLS", cells)
    monkeypatch.setattr(divergence, "SCORED_CELLS", cells)
    monkeypatch.setattr(divergence, "SLICE_BYTES", max(100, held))
    rows = term_rows()
    result = divergence.audit(documents(spark, rows))
    found = [tuple(row) for row in result.collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected(rows)


def test_few_top_terms(spark):
    rows = term_rows()
    found = {tuple(row) for row in divergence.audit(documents(spark, rows), min_docs=1, top_terms=2).collect()}
    assert found == expected(rows, 1, 2)


def test_empty_table(spark):
    assert divergence.audit(documents(spark, [])).collect() == []


def test_exact_probability_of_large_counts():
    count, total = np.array([0, 7, 10**15 - 1]), np.array([10**15 + 3] * 3)
    found = divergence.probability(count, total)
    assert found.tolist() == [1 + 10**9 * (c + 1) // (10**15 + 3) for c in count.tolist()]
