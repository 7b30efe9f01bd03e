from __future__ import annotations

from collections import Counter

import pytest

from embergrid.llm import ngram_join
from tests.llm.data import BASE, CLASHING, awkward_rows, documents, near


def sets_of(text):
    words = [word.decode() for word in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def brute_force(rows):
    sets = [sets_of(row[1]) for row in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= 75 * (len(one) + len(sets[j]) - both):
                label[root(i)] = root(j)
    ids = {}
    for i, row in enumerate(rows):
        ids.setdefault(root(i), []).append(row[0])
    smallest = {key: min((x for x in found if x is not None), default=None) for key, found in ids.items()}
    return Counter((row[0], len(sets[i]), smallest[root(i)]) for i, row in enumerate(rows))


def result_of(spark, rows):
    result = ngram_join.jaccard_components(documents(spark, rows))
    return Counter(tuple(row) for row in result.collect())


def test_awkward_rows(spark):
    rows = awkward_rows()
    assert result_of(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("rounds,per_row", [(1, 10**9), (4, 0)])
def test_near_copies_around_several_centres(spark, monkeypatch, rounds, per_row):
    # Copies at all distances, copies of copies, and a passage in common: many spaces have
    # outsiders, windows and links between them.
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", per_row)
    rows, number = [], 100
    passage = " ".join(f"p{k}" for k in range(40))
    for centre in range(3):
        start = " ".join(f"c{centre}_{k}" for k in range(60)) + " " + passage
        for changes in (0, 1, 2, 3, 4, 5, 7, 9, 12):
            for seed in range(3):
                one = near(start, changes, 50 + seed)
                rows.append((number, one, "en", "src0", 1))
                rows.append((number + 1, near(one, 2, 90 + seed), "en", "src0", 1))
                rows.append((number + 2, one + f" tail{seed} " * seed, "en", "src0", 1))
                number += 3
    rows = [row + CLASHING for row in rows]
    assert result_of(spark, rows) == brute_force(rows)


def test_chain_is_one_component(spark):
    # Neighbours link, the ends do not.
    words = BASE.split(" ")
    rows = [(k, " ".join(words[:50] + [f"z{j}" for j in range(k)]), "en", "s", 1) + CLASHING for k in range(0, 60, 4)]
    expected = brute_force(rows)
    assert result_of(spark, rows) == expected
    assert len({row[2] for row in expected}) == 1


@pytest.mark.parametrize("versions,rounds", [(2, 3), (3, 4)])
def test_links_between_regions_of_versions(spark, monkeypatch, versions, rounds):
    # The pivot of each version is far from the other versions; only members of the regions link.
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(ngram_join, "ESTIMATE_FROM", 1)
    core = [f"core{k}" for k in range(60)]
    rows, sets = [], []
    for version in range(versions):
        own = [f"v{version}_{k}" for k in range(18)]
        sets.append(core + own)
        for member in range(4):
            sets.append(core + own[:4] + [f"u{version}_{member}_{k}" for k in range(4)])
        # Elsewhere these words are common, so the order of anchors puts them behind the core.
        sets += [own + [f"f{version}_{number}_{k}" for k in range(100)] for number in range(40)]
    rows = [(k, " ".join(words), "en", "s", 1) + CLASHING for k, words in enumerate(sets)]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if at == high else at for at in label]
    found = ngram_join.jaccard_components(documents(spark, rows), words=1).collect()
    assert {row["doc_id"]: row["component_id"] for row in found} == dict(enumerate(label))
    assert sum(at == 0 for at in label) == 5 * versions


def test_empty_table(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).collect() == []
