from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from embergrid.llm import clustering

SCHEMA = "vec_id bigint, embedding array<float>, ids bigint, near string, cluster int, distance bigint, vector string"
CLASHING = (1, "n", 3, 4, "v")


def expected(rows, k, rounds, dims, scale=1024):
    kept = []
    for number, vector, *_ in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((number, [math.floor(scale * x) for x in vector]))

    def first(row):
        number = row[0]
        return (number is None, hashlib.sha256(f"3:{number}".encode()).hexdigest(), row[1])

    centroids = [vector for _, vector in sorted(kept, key=first)[:k]]

    def nearest(vector):
        squares = [sum((x - y) ** 2 for x, y in zip(vector, one)) for one in centroids]
        return min((square, place) for place, square in enumerate(squares))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, vector in kept:
            members[nearest(vector)[1]].append(vector)
        centroids = [
            [sum(column) // len(own) for column in zip(*own)] if own else old
            for own, old in zip(members, centroids)
        ]
    found = [(number, *reversed(nearest(vector))) for number, vector in kept]
    inertia = Counter()
    for _, cluster, square in found:
        inertia[cluster] += square
    digests = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in centroids]
    total = sum(inertia.values())
    return Counter((n, c, d, inertia[c], total, digests[c]) for n, c, d in found)


def vectors(count, dims, seed, spread=0.2):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for number in range(count):
        middle = middles[min(rng.randrange(8), 3)]
        values = np.array([x + rng.gauss(0, spread) for x in middle], np.float32)
        rows.append((number, values.tolist(), *CLASHING))
    return rows


def awkward(dims):
    rows = vectors(300, dims, 3)
    good = rows[5][1]
    rows += [rows[0]] * 40 + [(None, good, *CLASHING), (None, rows[7][1], *CLASHING)]
    rows += [(number, good, *CLASHING) for number in range(1000, 1100)]
    rows += [
        (900, None, *CLASHING),
        (901, [], *CLASHING),
        (902, good[:-1], *CLASHING),
        (903, [None, *good[1:]], *CLASHING),
        (904, [float("nan"), *good[1:]], *CLASHING),
        (905, [float("inf"), *good[1:]], *CLASHING),
        (906, [0.0] * dims, *CLASHING),
        (907, [-0.0] * dims, *CLASHING),
    ]
    return rows


@pytest.mark.parametrize("k, rounds", [(8, 10), (1, 3), (20, 4), (1000, 2)])
def test_clusters_against_plain_rounds(spark, k, rounds):
    rows = awkward(6)
    result = clustering.with_inertia(
        *clustering.k_means(spark.createDataFrame(rows, SCHEMA), k=k, rounds=rounds, dims=6, block_rows=50)
    )
    assert Counter(map(tuple, result.collect())) == expected(rows, k, rounds, 6)


def test_large_components_stay_exact(spark):
    rows = [(number, [float(2**17 * (number % 3)), 3.0], *CLASHING) for number in range(40)]
    result = clustering.with_inertia(*clustering.k_means(spark.createDataFrame(rows, SCHEMA), k=3, rounds=4, dims=2))
    assert Counter(map(tuple, result.collect())) == expected(rows, 3, 4, 2)


def test_distance_beyond_a_long_is_an_error(spark):
    rows = [(number, [1e12 * number, 3.0], *CLASHING) for number in range(9)]
    with pytest.raises(Exception, match="does not fit a long"):
        clustering.k_means(spark.createDataFrame(rows, SCHEMA), k=2, rounds=1, dims=2)


def test_empty_table(spark):
    found, centroids = clustering.k_means(spark.createDataFrame([], SCHEMA))
    assert centroids == [] and clustering.with_inertia(found, centroids).collect() == []


def test_search_computes_fewer_distances_than_a_full_scan():
    rows = np.array([[round(1024 * x) for x in row[1]] for row in vectors(4000, 16, 8, 0.1)])
    centroids = rows[:8].tolist()
    state, before, computed = None, None, []
    for _ in range(8):
        search = clustering.Search(centroids, before)
        state = search.assign(rows, state)
        squares = np.stack([((rows - one) ** 2).sum(axis=1) for one in np.array(centroids)])
        assert (squares.argmin(axis=0) == state[0]).all()
        computed.append(search.computed)
        before = centroids
        centroids = [
            (rows[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum())).tolist() for c in range(8)
        ]
    assert computed[-1] < 4000 * 8 / 2
