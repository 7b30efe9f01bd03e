from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.llm import topk_search

SCHEMA = "vec_id bigint, embedding array<float>, score double, tree string, rank int"


def brute_force(rows, k=5):
    vectors = {}
    for number, vector in rows:
        if number is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        vectors[number] = max(vectors.get(number, whole), whole)
    found = set()
    for q, one in vectors.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(one, two)), c) for c, two in vectors.items() if c != q and len(two) == len(one))
            found |= {(q, rank + 1, c, -score) for rank, (score, c) in enumerate(scored[:k])}
    return found


def search(spark, rows, **options):
    df = spark.createDataFrame([(n, v, 1.0, "t", 3) for n, v in rows], SCHEMA)
    return {tuple(row) for row in topk_search.top_k(df, F.col("vec_id") % 50 == 0, **options).collect()}


def test_awkward_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(int(n), rng.normal(size=6).tolist()) for n in range(400)]
    rows += [(1000 + n, [1.0] * 6) for n in range(300)]  # equal scores
    rows += [(5, rows[5][1]), (7, [9.0] * 6), (2000, None), (2050, [float("nan")] * 6), (2051, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(None, [1.0] * 6), (2052, [float("inf")] * 6), (2053, []), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3050, [4.0, 4.0])]
    assert search(spark, rows, shard_rows=100, block_queries=3, leaf_rows=8) == brute_force(rows)


def test_fewer_vectors_than_asked_for_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [0.0, 0.0])]
    assert search(spark, rows) == brute_force(rows)
    assert search(spark, []) == set()


def test_boxes_are_tight_and_bound_scores():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-300, 300, (500, 8))
    tree = topk_search.KdTree(np.arange(500), vectors, 16)
    query = rng.integers(-300, 300, (1, 8))
    bounds = tree.bounds(query)[0]
    for node, (start, stop) in enumerate(tree.ends):
        rows = tree.vectors[start:stop]
        assert (tree.low_faces[node] == rows.min(axis=0)).all() and (tree.high_faces[node] == rows.max(axis=0)).all()
        assert bounds[node] >= (rows @ query[0]).max()


def test_large_components_stay_exact():
    one = np.array([[2**40, 3]])
    assert topk_search.product(one, np.array([[2**20, 1]]))[0, 0] == 2**60 + 3
    two = np.array([[2**62, 2**61, 2**60]])
    assert topk_search.product(two, two)[0, 0] == 2**124 + 2**122 + 2**120


def test_sums_beyond_a_long_do_not_wrap(spark):
    # The opposite vector is the worst match, though its product would wrap to a large number.
    rows = [(0, [2.0**20, 1.0]), (1, [-(2.0**23), 2.0]), (2, [2.0**10, 0.0]), (3, [0.0, 1.0])]
    assert search(spark, rows, k=3) == brute_force(rows, 3)
    with pytest.raises(Exception, match="(?i)too large|overflow|out of bounds"):
        search(spark, [(0, [2.0**30, 1.0]), (1, [2.0**30, 1.0]), (2, [-(2.0**30), 2.0])])
