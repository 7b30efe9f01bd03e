from __future__ import annotations

from collections import Counter, defaultdict

from embergrid.llm import mixing
from tests.llm.data import documents

SCHEMA = "id bigint, domain string, lang string, source string, tokens bigint"


def shares(budget, nodes):
    """Fill by weight, fix whoever is full, and deal the rest out again."""
    left, given = dict(nodes), {}
    while left:
        total = sum(weight for _, weight in left.values())
        full = {k for k, (supply, weight) in left.items() if supply * total <= budget * weight}
        if not full:
            given |= {k: budget * weight // total for k, (_, weight) in left.items()}
            break
        for k in full:
            given[k] = left.pop(k)[0]
            budget -= given[k]
    return given


def budgets(rows, weights, budget, epochs):
    supply = defaultdict(int)
    for row in rows:
        for depth in range(4):
            supply[row[1 : 1 + depth]] += row[4] * epochs
    found = {(): budget}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in [k for k in found if len(k) == depth]:
            nodes = {
                k: (total, weights.get(level, {}).get(k[-1], 1))
                for k, total in supply.items()
                if len(k) == depth + 1 and k[:-1] == parent
            }
            found |= shares(found[parent], {k: v for k, v in nodes.items() if v[1] > 0})
    return {k: v for k, v in found.items() if len(k) == 3}


def check(spark, rows, weights, percent, epochs, **options):
    chosen = mixing.select_mix(spark.createDataFrame(rows, SCHEMA), weights=weights, budget_percent=percent, epochs=epochs, **options)
    found = chosen.collect()
    total = sum(row[4] for row in rows)
    want = budgets(rows, weights, total * percent // 100, epochs)
    taken, largest, leaf_tokens = Counter(), defaultdict(int), Counter()
    for row in rows:
        largest[row[1:4]] = max(largest[row[1:4]], row[4])
        leaf_tokens[row[1:4]] += row[4]
    for row in found:
        leaf = (row["domain"], row["lang"], row["source"])
        taken[leaf] += row["tokens"]
        # A prefix: what came before in the epochs and this row fit the budget.
        assert row["epoch"] * leaf_tokens[leaf] + row["tokens_before"] + row["tokens"] <= want[leaf]
    for leaf, given in want.items():
        # Whole epochs, then up to the first document that does not fit.
        assert given - largest[leaf] < taken[leaf] <= given or given == 0
    return found


def test_shortages_go_to_siblings_first(spark):
    rows = [(k, "a", "en", "s1", 10) for k in range(10)]
    rows += [(100 + k, "a", "de", "s1", 10) for k in range(100)]
    rows += [(300 + k, "b", "en", "s2", 10) for k in range(300)]
    weights = {"domain": {"a": 1, "b": 1}, "lang": {"en": 9, "de": 1}}
    found = check(spark, rows, weights, 40, 1)
    taken = Counter()
    for row in found:
        taken[row["domain"], row["lang"]] += row["tokens"]
    # a/en has 100 of its 738; a/de takes the rest of a's half, b keeps its own half.
    assert taken == {("a", "en"): 100, ("a", "de"): 720, ("b", "en"): 820}


def test_several_epochs_slices_and_zero_weights(spark):
    rows = [(k, f"d{k % 2}", f"l{k % 3}", f"s{k % 5}", k % 17) for k in range(900)]
    rows += [(k, "d0", "l0", "s0", 7) for k in range(2000, 2600)]
    weights = {"domain": {"d0": 3, "d1": 1}, "lang": {"l1": 0}, "source": {"s2": 5}}
    found = check(spark, rows, weights, 120, 3, slice_rows=50)
    assert not any(row["lang"] == "l1" for row in found) and max(row["epoch"] for row in found) == 2


def test_slices_do_not_change_the_choice(spark):
    rows = [(k, "d", "l", "s", k % 13) for k in range(500)]
    picks = [
        {(row["id"], row["tokens_before"]) for row in check(spark, rows, {}, 30, 1, slice_rows=size)} for size in (10, 10_000)
    ]
    assert picks[0] == picks[1]


def test_awkward_rows(spark):
    rows = mixing.with_tree(documents(spark))
    everything = mixing.select_mix(rows, weights={}, budget_percent=100, epochs=1)
    assert everything.count() == rows.count()
    assert {row[0] for row in rows.select("lang").distinct().collect()} >= {mixing.MISSING}
    none = mixing.select_mix(mixing.with_tree(documents(spark, [])))
    assert none.collect() == []
