"""Feature shaping, filters, focus labels and geometry on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.operators.classify import label_focus
from embergrid.operators.features import feature_key, in_bounds, numeric_property, point_columns
from embergrid.operators.geometry import (
    boxes_overlapping,
    edge_boxes,
    polygon_edges,
    rings_from_geojson,
    polygons_in_envelope,
    shaped_rings,
    thin_edges,
)
from embergrid.operators.query import feature_query


def test_point_columns(spark):
    cases = [
        ({"type": "Point", "coordinates": [-121.3, "44.1"]}, (-121.3, 44.1)),
        ({"type": "Point", "coordinates": [-121, 44, 900]}, (-121.0, 44.0)),
        ({"type": "Point", "coordinates": "x"}, (None, None)),
        ({"type": "Point"}, (None, None)),
        ({"type": "MultiPoint", "coordinates": [[-120.5, 43.5], [1, 2]]}, (-120.5, 43.5)),
        ({"type": "MultiPoint", "coordinates": []}, (None, None)),
        ({"type": "MultiPoint", "coordinates": [-120.5, 43.5]}, (None, None)),
        ({"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}, (None, None)),
        ({"coordinates": [1, 2]}, (None, None)),
        (None, (None, None)),
    ]
    rows = [(i, json.dumps(geometry)) for i, (geometry, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i INT, g STRING").withColumn(
        "geometry", F.try_parse_json("g")
    )
    found = point_columns(frame).orderBy("i").select("lon", "lat").collect()
    assert [tuple(row) for row in found] == [expected for _, expected in cases]


def test_bounds_include_all_four_sides(spark):
    west, south, east, north = fixed.DATA_BOUNDS
    inside = [(west, 44.0), (east, 44.0), (-120.0, south), (-120.0, north), (west, south)]
    outside = [
        (west - 1e-9, 44.0),
        (east + 1e-9, 44.0),
        (-120.0, south - 1e-9),
        (-120.0, north + 1e-9),
        (None, 44.0),
        (-120.0, None),
    ]
    frame = spark.createDataFrame(inside + outside, "lon DOUBLE, lat DOUBLE")
    once = in_bounds(frame)
    assert sorted(map(tuple, once.collect())) == sorted(inside)
    assert sorted(map(tuple, in_bounds(once).collect())) == sorted(inside)


def test_numeric_property_takes_first_finite_alias(spark):
    rows = [("5", "7"), ("", "7"), ("x", "7"), (None, None), ("NaN", "0"), ("0", "7")]
    frame = spark.createDataFrame(rows, "a STRING, b STRING")
    found = [row.n for row in numeric_property(frame, "n", ["a", "b"]).collect()]
    assert found == [5.0, 7.0, 7.0, None, 0.0, 0.0]


def test_feature_key(spark):
    frame = spark.createDataFrame([("p", 1), (None, 2), (None, None)], "id STRING, fid BIGINT")
    found = [row[0] for row in frame.select(feature_key("id", "fid")).collect()]
    assert found == ["p", "2", None]


BOUNDARY = "oid BIGINT, state_fips STRING, geoid STRING"


def test_first_match_is_focus_and_comes_last(spark):
    frame = spark.createDataFrame(
        [(3, "41", None), (1, "06", None), (2, None, "41"), (4, None, None)], BOUNDARY
    )
    found = {row.oid: (row.kind, row.draw_order) for row in label_focus(frame).collect()}
    assert found == {
        1: ("outside", 0), 2: ("oregon", 1), 3: ("outside", 0), 4: ("outside", 0),
    }


def test_missing_focus_is_an_error(spark):
    frame = spark.createDataFrame([(1, "06", None)], BOUNDARY)
    with pytest.raises(PySparkException, match=fixed.BOUNDARY_MISSING_ERROR):
        label_focus(frame).collect()
    # Whatever columns are read.
    with pytest.raises(PySparkException, match=fixed.BOUNDARY_MISSING_ERROR):
        label_focus(frame).select("oid").collect()


def test_focus_per_set(spark):
    rows = [("a", 1, "06", None), ("a", 2, "41", None), ("b", 1, "41", None), ("b", 2, "41", None)]
    frame = spark.createDataFrame(rows, f"set_id STRING, {BOUNDARY}")
    found = {(r.set_id, r.oid): r.kind for r in label_focus(frame, set_id="set_id").collect()}
    assert found == {
        ("a", 1): "outside", ("a", 2): "oregon", ("b", 1): "oregon", ("b", 2): "outside",
    }
    lacking = frame.where("NOT (set_id = 'a' AND oid = 2)")
    with pytest.raises(PySparkException, match=fixed.BOUNDARY_MISSING_ERROR):
        label_focus(lacking, set_id="set_id").collect()
    unnamed = spark.createDataFrame([(None, 1, "06", None), (None, 2, "41", None)], frame.schema)
    both = label_focus(frame.unionByName(unnamed), set_id="set_id")
    assert both.count() == 6 and both.where("set_id IS NULL AND kind = 'oregon'").count() == 1


def _geometry(spark, *geometries):
    rows = [(i, json.dumps(geometry)) for i, geometry in enumerate(geometries)]
    frame = spark.createDataFrame(rows, "geom_id INT, g STRING")
    return frame.withColumn("rings", rings_from_geojson(F.try_parse_json("g")))


SQUARE = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
SHIFTED = [[5, 5], [6, 5], [6, "6"], [5, 5]]


def test_edges_of_polygon_and_multipolygon(spark):
    frame = _geometry(
        spark,
        {"type": "Polygon", "coordinates": [SQUARE]},
        {"type": "MultiPolygon", "coordinates": [[SQUARE], [SHIFTED]]},
        {"type": "Point", "coordinates": [1, 2]},
        {"type": "Polygon", "coordinates": []},
        {"type": "Polygon", "coordinates": [[[0, 0]]]},
    )
    rows = polygon_edges(frame).collect()
    assert sorted((r.geom_id, r.ring, r.seq) for r in rows) == sorted(
        [(0, 0, i) for i in range(4)]
        + [(1, 0, i) for i in range(4)]
        + [(1, 1, i) for i in range(3)]
    )
    last = next(r for r in rows if (r.geom_id, r.ring, r.seq) == (1, 1, 2))
    assert (last.x1, last.y1, last.x2, last.y2) == (6.0, 6.0, 5.0, 5.0)


def test_thinning_joins_up_and_drops_collapsed_rings(spark):
    ring = [[0, 0], [0.001, 0.001], [1, 0], [1.002, 0.0], [1, 1], [0, 0]]
    speck = [[5, 5], [5.001, 5], [5.001, 5.001], [5, 5]]
    sliver = [[7, 7], [7.2, 7], [7.2, 7.001], [7, 7]]
    polygon = {"type": "Polygon", "coordinates": [ring, speck, sliver]}
    frame = polygon_edges(_geometry(spark, polygon))
    rows = thin_edges(frame, 0.01).orderBy("ring", "seq").collect()
    assert {r.ring for r in rows} == {0}
    ends = [(r.x1, r.y1, r.x2, r.y2) for r in rows]
    assert ends == [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0)]


def test_box_overlap_includes_touching(spark):
    edges = polygon_edges(_geometry(spark, {"type": "Polygon", "coordinates": [SQUARE]}))
    boxes = edge_boxes(edges)
    assert boxes_overlapping(boxes, (1.0, 1.0, 2.0, 2.0)).count() == 1
    assert boxes_overlapping(boxes, (1.001, 0.0, 2.0, 2.0)).count() == 0


ENVELOPE = (0.0, 0.0, 1.0, 1.0)
IN_ENVELOPE = {
    "inside": ([[[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.2]]], True),
    "around": ([[[-5, -5], [5, -5], [5, 5], [-5, 5], [-5, -5]]], True),
    "in its hole": ([[[-5, -5], [5, -5], [5, 5], [-5, 5], [-5, -5]], [[-1, -1], [2, -1], [2, 2], [-1, 2], [-1, -1]]], False),
    "across": ([[[-1, 0.4], [2, 0.5], [2, 0.6], [-1, 0.4]]], True),
    "only its box": ([[[1.5, -1], [2, -1], [2, 3], [-1, 3], [-1, 2.5], [1.5, 2.5], [1.5, -1]]], False),
    "past a corner": ([[[0.5, 3], [3, 0.5], [3, 3], [0.5, 3]]], False),
    "at a corner": ([[[1, 1], [2, 1], [2, 2], [1, 1]]], True),
    "through a corner": ([[[0.5, 1.5], [1.5, 0.5], [2, 2], [0.5, 1.5]]], True),
    "along a side": ([[[1, 0.2], [2, 0.2], [2, 0.8], [1, 0.8], [1, 0.2]]], True),
    "beside": ([[[1.01, 0], [2, 0], [2, 1], [1.01, 0]]], False),
}


def test_area_in_envelope(spark):
    rows = [(name, rings) for name, (rings, _) in IN_ENVELOPE.items()]
    rows = [(name, [[[float(x) for x in at] for at in ring] for ring in rings]) for name, rings in rows]
    frame = spark.createDataFrame(rows, "geom_id STRING, rings ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    found = {row.geom_id for row in polygons_in_envelope(polygon_edges(frame), ENVELOPE).collect()}
    assert found == {name for name, (_, meets) in IN_ENVELOPE.items() if meets}
    boxes = {row.geom_id for row in boxes_overlapping(edge_boxes(polygon_edges(frame)), ENVELOPE).collect()}
    assert found < boxes


def test_small_polygons_keep_a_ring(spark):
    def ring(size):
        return [[str(-121 + x * size), str(44 + y * size)] for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]

    sizes = (0.5, 0.003, 0.0004, 1e-6)
    frame = spark.createDataFrame(
        [(number, [ring(size), ring(size / 2)]) for number, size in enumerate(sizes)],
        "id INT, rings ARRAY<ARRAY<ARRAY<STRING>>>",
    )
    rows = frame.select("id", shaped_rings(F.col("rings"), 3, 0.01).alias("rings")).orderBy("id").collect()
    assert [len(row.rings) for row in rows] == [2, 1, 1, 1]
    for row, size in zip(rows, sizes):
        outer = row.rings[0]
        assert outer[0] == outer[-1] and len({tuple(at) for at in outer}) >= 3
        for x, y in outer:
            assert min(max(abs(x - float(a)), abs(y - float(b))) for a, b in ring(size)) <= 0.01
    assert rows[1].rings[0][1] == [-120.997, 44.0]
    assert rows[3].rings[0][1] == [-121 + 1e-6, 44.0]


def test_feature_query_defaults_and_overrides(spark):
    frame = spark.createDataFrame(
        [(3, "a", -120.0, 44.0), (1, "b", -120.1234, 44.5678), (2, "a", 0.0, 0.0)],
        "OBJECTID INT, tag STRING, lon DOUBLE, lat DOUBLE",
    )
    assert [r.OBJECTID for r in feature_query(frame).collect()] == [1, 2, 3]
    assert feature_query(frame).columns == frame.columns
    picked = feature_query(frame, where="tag = 'a'", fields=["tag"], offset=1, limit=1).collect()
    assert [tuple(r) for r in picked] == [("a",)]
    near = feature_query(frame, bounds=fixed.DATA_BOUNDS, precision=3).collect()
    assert [(r.lon, r.lat) for r in near] == [(-120.123, 44.568), (-120.0, 44.0)]
