"""Simplification of borders: offset, common borders, rings that stay, awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.operators import simplify
from embergrid.operators.simplify import kept_vertices, simplify_edges

SCHEMA = "geom_id INT, ring INT, seq INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, note STRING"
OFFSET = 0.05


def distance(at, one, two):
    (x, y), (ax, ay), (bx, by) = at, one, two
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    share = min(max(((x - ax) * dx + (y - ay) * dy) / square, 0.0), 1.0) if square else 0.0
    return math.hypot(x - (ax + share * dx), y - (ay + share * dy))


def plain_rule(points, tolerance):
    """Positions that stay, by recursion."""
    inner = [(distance(points[i], points[0], points[-1]), -i) for i in range(1, len(points) - 1)]
    if not inner or max(inner)[0] <= tolerance:
        return [0, len(points) - 1]
    at = -max(inner)[1]
    return plain_rule(points[: at + 1], tolerance)[:-1] + [at + i for i in plain_rule(points[at:], tolerance)]


def test_rounds_equal_recursion():
    rng = np.random.default_rng(3)
    arcs = [np.cumsum(rng.normal(size=(int(n), 2)), axis=0) for n in rng.integers(2, 60, 40)]
    arcs.append(np.vstack([arcs[-1], arcs[-1][:1]]))
    tolerance = rng.uniform(0, 2, len(arcs))
    offsets = np.cumsum([0, *map(len, arcs)])
    x, y = np.vstack(arcs).T
    kept = kept_vertices(x, y, offsets, tolerance)
    for number, arc in enumerate(arcs):
        found = np.flatnonzero(kept[offsets[number] : offsets[number + 1]]).tolist()
        assert found == plain_rule([tuple(at) for at in arc.tolist()], tolerance[number])


def wave(one, two, seed, steps=40):
    """Vertices of a shaky line from one corner up to the next."""
    rng = np.random.default_rng(seed)
    share = np.arange(steps) / steps
    shake = rng.uniform(-0.06, 0.06, (steps, 2)) * (share > 0)[:, None]
    return [tuple(at) for at in (np.array(one) + share[:, None] * (np.array(two) - np.array(one)) + shake).tolist()]


def rows_of(geom, ring, vertices, note="n"):
    ends = zip(vertices, [*vertices[1:], vertices[0]])
    return [(geom, ring, seq, *a, *b, note) for seq, (a, b) in enumerate(ends)]


def turned(vertices):
    return [vertices[0], *vertices[:0:-1]]


@pytest.fixture(scope="module")
def rings():
    a, b, c, d, e, f = (0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (0.0, 2.0)
    border = [*wave(b, e, 1), e]
    left = [*wave(a, b, 2), *border[:-1], *wave(e, f, 3), *wave(f, a, 4)]
    right = [*border[::-1], *wave(b, c, 5)[1:], *wave(c, d, 6), *wave(d, e, 7)]
    angles = np.arange(60) * 2 * math.pi / 60
    island = [(1 + 0.4 * math.cos(t), 1 + 0.4 * math.sin(t)) for t in angles.tolist()]
    speck = [(3 + 0.01 * math.cos(t), 1 + 0.01 * math.sin(t)) for t in angles.tolist()]
    far = [(9.0, 9.0), (9.5, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 10.0)]
    sliver = [(6.0, 6.0), (8.0, 6.001), (8.0, 6.002), (6.0, 6.002)]
    return {
        (1, 0): left,
        (1, 1): turned(island),
        (2, 0): right,
        (3, 0): island[20:] + island[:20],
        (4, 0): speck,
        (5, 0): far,
        (6, 0): sliver,
        # A copy, its first vertex elsewhere, without an id.
        (None, 0): left[7:] + left[:7],
    }


def frame_of(spark, rings):
    rows = [row for (geom, ring), vertices in rings.items() for row in rows_of(geom, ring, vertices)]
    return spark.createDataFrame(rows, SCHEMA)


def by_ring(edges):
    found = {}
    for row in sorted(edges.collect(), key=lambda row: row.seq):
        found.setdefault((row.geom_id, row.ring), []).append(((row.x1, row.y1), (row.x2, row.y2)))
    return found


def area(edges):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in edges) / 2


@pytest.mark.parametrize("sizes", [{}, {"piece": 9, "block": 7}])
def test_borders_stay_common_within_the_offset(spark, rings, sizes):
    found = by_ring(simplify_edges(frame_of(spark, rings), OFFSET, **sizes))
    assert set(found) == set(rings)
    for key, vertices in rings.items():
        edges = found[key]
        assert all(one[1] == two[0] for one, two in zip(edges, [*edges[1:], edges[0]]))
        assert {one for one, _ in edges} <= set(vertices)
        assert max(min(distance(at, *edge) for edge in edges) for at in vertices) <= OFFSET + 1e-12
        whole = area(list(zip(vertices, [*vertices[1:], vertices[0]])))
        assert area(edges) / whole >= 0.5 and len(edges) >= 3
    assert len(found[1, 0]) < 100 and len(found[5, 0]) == (4 if not sizes else len(found[5, 0]))
    back = {(b, a) for a, b in found[2, 0]}
    shared = [edge for edge in found[1, 0] if edge in back]
    assert shared[0][0] == (2, 0) and shared[-1][1] == (2, 2)
    assert all(one[1] == two[0] for one, two in zip(shared, shared[1:]))
    assert {(b, a) for a, b in found[1, 1]} == set(found[3, 0])
    assert set(found[None, 0]) == set(found[1, 0])


def test_arcs_equal_the_plain_rule(spark, rings):
    """Without cuts by place, the border of two polygons is one arc from corner to corner."""
    found = by_ring(simplify_edges(frame_of(spark, {key: rings[key] for key in ((1, 0), (2, 0))}), OFFSET, piece=1 << 60))
    vertices = rings[1, 0]
    start, stop = vertices.index((2.0, 0.0)), vertices.index((2.0, 2.0))
    line = vertices[start : stop + 1]
    # Both rings are wide enough for the whole offset.
    expected = [line[i] for i in plain_rule(line, OFFSET)]
    kept = [one for one, _ in found[1, 0]]
    assert kept[kept.index((2.0, 0.0)) : kept.index((2.0, 2.0)) + 1] == expected


def test_awkward_rows(spark, rings):
    rows = rows_of(1, 0, rings[5, 0])
    # A vertex twice, and one that is missing: the ring is open there.
    rows = [(g, r, 2 * s, *rest) for g, r, s, *rest in rows] + [(1, 0, 1, 9.5, 9.0, 9.5, 9.0, "twice")]
    gap = [row for row in rows_of(2, 0, wave((20, 0), (30, 0), 8)) if row[2] not in (10, 11)]
    gap += [(2, 0, 10, 1.0, 1.0, None, 1.0, "gap")]
    found = by_ring(simplify_edges(spark.createDataFrame(rows + gap, SCHEMA), OFFSET))
    assert [one for one, _ in found[1, 0]] == [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 10.0)]
    assert all(at in {v for a, b in found[2, 0] for v in (a, b)} for at in (gap[9][5:7], gap[10][3:5]))
    flat = rows_of(7, 0, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (1.0, 1.0)])
    assert (7, 0) in by_ring(simplify_edges(spark.createDataFrame(flat, SCHEMA), OFFSET))
    empty = simplify_edges(spark.createDataFrame([], SCHEMA), OFFSET)
    assert empty.columns == ["geom_id", "ring", "seq", "x1", "y1", "x2", "y2"] and empty.count() == 0
    other = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("geom_id", "key").withColumn("n", F.lit(1))
    assert simplify_edges(other, OFFSET, "key").columns[0] == "key"


def test_edges_are_shuffled_for_cuts_and_blocks_only(spark, rings):
    """Whatever a ring's facts take, its edges move to their vertices and to their blocks, no more."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = frame_of(spark, rings).drop("note").localCheckpoint()
        pieces = simplify._pieces(edges, 9, 7)
        found = pieces._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in found.splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in moved if "seq#" in line or "geom_id#" in line or "x1#" in line]) <= 4
    assert len([line for line in moved if "block#" in line]) == 1
    for row in pieces.collect():
        seqs = [edge.seq for edge in row.way]
        assert len({seq // 7 for seq in seqs}) == 1 and sorted(seqs) == list(range(min(seqs), max(seqs) + 1))
        assert row.start is None or row.start == min(seqs)
