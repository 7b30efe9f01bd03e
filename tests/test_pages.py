"""Landed pages: triage, flags, features; page sets against a sequential scan."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from embergrid.operators.page_directory import page_between, page_directory
from embergrid.operators.paging import assign_pages, page_slice, page_status, rank_rows
from embergrid.sources.landed_pages import (
    page_facts,
    page_features,
    page_outcomes,
    property_text,
    refetch_list,
)

LANDED = "layer STRING, result_offset BIGINT, http_status INT, body STRING"


def landed(spark, responses):
    rows = [("x", index, status, body) for index, (status, body) in enumerate(responses)]
    return spark.createDataFrame(rows, LANDED)


def error(**parts):
    return json.dumps({"error": parts})


TRIAGE = [
    # http status, body, outcome, retryable, message
    (200, '{"features":[]}', "ok", None, None),
    (204, "{}", "ok", None, None),
    (200, '{"error":null}', "ok", None, None),
    (200, '{"error":false}', "ok", None, None),
    (200, '{"error":""}', "ok", None, None),
    (200, '{"error":0}', "ok", None, None),
    (200, "[1, 2]", "ok", None, None),
    (200, error(code=500, message="busy"), "service_error", True, "busy"),
    (200, error(code=429, message="slow"), "service_error", True, "slow"),
    (200, error(code="429", message="slow"), "service_error", False, "slow"),
    (200, error(code="500", message="busy"), "service_error", True, "busy"),
    (200, error(code=400, message="bad"), "service_error", False, "bad"),
    (503, error(code=400, message="bad"), "service_error", False, "bad"),
    (200, error(code="x"), "service_error", False, "ArcGIS query HTTP 200"),
    (503, error(), "service_error", True, "ArcGIS query HTTP 503"),
    (503, error(code=None, message=""), "service_error", True, "ArcGIS query HTTP 503"),
    (200, '{"error":"text"}', "service_error", False, "ArcGIS query HTTP 200"),
    (404, "{}", "service_error", False, "ArcGIS query HTTP 404"),
    (429, "{}", "service_error", True, "ArcGIS query HTTP 429"),
    (500, "{}", "service_error", True, "ArcGIS query HTTP 500"),
    (408, "{}", "service_error", False, "ArcGIS query HTTP 408"),
    (200, "<html>", "invalid_json", False, "ArcGIS returned invalid JSON (HTTP 200): <html>"),
    (400, "<html>", "invalid_json", True, "ArcGIS returned invalid JSON (HTTP 400): <html>"),
    (408, "a \n b", "invalid_json", True, "ArcGIS returned invalid JSON (HTTP 408): a b"),
    (429, "", "invalid_json", True, "ArcGIS returned invalid JSON (HTTP 429)"),
    (503, "  ", "invalid_json", True, "ArcGIS returned invalid JSON (HTTP 503)"),
    (404, "no", "invalid_json", False, "ArcGIS returned invalid JSON (HTTP 404): no"),
    (200, "{} {}", "invalid_json", False, "ArcGIS returned invalid JSON (HTTP 200): {} {}"),
    (200, "{}, {}", "invalid_json", False, "ArcGIS returned invalid JSON (HTTP 200): {}, {}"),
    (200, "{}]", "invalid_json", False, "ArcGIS returned invalid JSON (HTTP 200): {}]"),
    (200, "{}],[1", "invalid_json", False, "ArcGIS returned invalid JSON (HTTP 200): {}],[1"),
    (None, None, "no_response", True, None),
]


def test_triage(spark):
    pages = landed(spark, [(status, body) for status, body, *_ in TRIAGE])
    rows = page_outcomes(pages).orderBy("result_offset").collect()
    for row, (status, body, *expected) in zip(rows, TRIAGE, strict=True):
        assert [row.outcome, row.retryable, row.message] == expected, (status, body)


def test_refetch_list(spark):
    pages = landed(spark, [(status, body) for status, body, *_ in TRIAGE])
    wanted = [index for index, case in enumerate(TRIAGE) if case[3]]
    assert sorted(row.result_offset for row in refetch_list(pages).collect()) == wanted


def test_transfer_flag_must_be_true_boolean(spark):
    cases = {
        '{"exceededTransferLimit":true}': True,
        '{"exceededTransferLimit":"true"}': False,
        '{"exceededTransferLimit":1}': False,
        '{"properties":{"exceededTransferLimit":true}}': True,
        '{"exceededTransferLimit":null,"properties":{"exceededTransferLimit":true}}': True,
        '{"exceededTransferLimit":false,"properties":{"exceededTransferLimit":true}}': False,
        '{"exceededTransferLimit":"true","properties":{"exceededTransferLimit":true}}': False,
        '{"properties":7}': False,
        "{}": False,
    }
    rows = page_facts(landed(spark, [(200, body) for body in cases])).orderBy("result_offset")
    assert [row.exceeded for row in rows.collect()] == list(cases.values())


def test_features_keep_page_order_and_tolerate_bad_pages(spark):
    body = json.dumps(
        {
            "features": [
                {
                    "id": 7,
                    "geometry": {"type": "Point", "coordinates": [1, 2]},
                    "properties": {"name": "a", "size": 12.5, "tags": {"k": [1]}},
                },
                None,
                {"properties": None},
                {"id": "s", "geometry": None, "properties": {"name": None}},
            ]
        }
    )
    pages = landed(
        spark,
        [(200, body), (200, '{"features":3}'), (200, "{}"), (200, "[]"), (500, body), (200, "x")],
    )
    rows = page_features(pages).select(
        "result_offset", "pos", "feature_id", "geom_type", property_text("name").alias("name"),
        property_text("size").alias("size"),
    ).orderBy("result_offset", "pos").collect()
    assert [tuple(row) for row in rows] == [
        (0, 0, "7", "Point", "a", "12.5"),
        (0, 1, None, None, None, None),
        (0, 2, None, None, None, None),
        (0, 3, "s", None, None, None),
    ]


PAGES = "layer STRING, result_offset BIGINT, page_len BIGINT, exceeded BOOLEAN"


def scan(pages, page_size):
    """Status of one layer by walking from offset to offset."""
    stops = [at for at, length, exceeded in pages if not exceeded and length < page_size]
    stuck = [at for at, length, exceeded in pages if exceeded and not length]
    if stuck and (not stops or min(stuck) <= min(stops)):
        return "not_advanced"
    pages = [(at, length, exceeded) for at, length, exceeded in pages if length or not exceeded]
    expected, visited, status = 0, set(), None
    while status is None:
        here = [page for page in pages if page[0] == expected]
        filled = [page for page in here if page[1]]
        visited.add(expected)
        if not here:
            status = "unfinished"
        elif len(filled) < len(here):
            status = "complete"
        elif len(filled) > 1:
            # Two filled pages at one offset contradict each other.
            status = "gap"
        elif not filled[0][2] and filled[0][1] < page_size:
            status = "complete"
        else:
            expected += filled[0][1]
    strays = [at for at, _, _ in pages if at not in visited]
    if status == "unfinished" and strays or any(at < expected for at in strays):
        return "gap"
    return status


CASES = {
    "one": [(0, 3, False)],
    "empty layer": [(0, 0, False)],
    "exact then empty": [(0, 10, False), (10, 0, False)],
    "capped pages": [(0, 4, True), (4, 4, True), (8, 2, False)],
    "no end": [(0, 10, True), (10, 10, True)],
    "full unflagged end": [(0, 10, False)],
    "first missing": [(10, 3, False)],
    "middle missing": [(0, 10, True), (20, 3, False)],
    "page twice": [(0, 10, True), (0, 10, True), (10, 3, False)],
    "overlap": [(0, 10, True), (5, 10, True), (15, 3, False)],
    "stuck": [(0, 10, True), (10, 0, True)],
    "stuck after the stop": [(0, 10, True), (10, 3, False), (13, 0, True)],
    "stop then more": [(0, 10, True), (10, 3, False), (13, 10, True)],
    "stop then gap": [(0, 3, False), (50, 10, True)],
    "empty stop off the chain": [(0, 10, True), (15, 0, False)],
    "jump over the stop": [(0, 10, True), (10, 30, True), (20, 3, False)],
}


def test_page_status_cases(spark):
    rows = [(name, *page) for name, pages in CASES.items() for page in pages]
    found = {r.layer: r for r in page_status(spark.createDataFrame(rows, PAGES), 10).collect()}
    for name, pages in CASES.items():
        assert found[name].status == scan(pages, 10), name
        assert found[name].pages == len(pages), name


def test_page_status_equals_scan_on_random_sets(spark):
    rng = random.Random(5)
    sets = {}
    for number in range(600):
        pages, at = [], 0
        for _ in range(rng.randint(1, 8)):
            length = rng.choice([10, 10, 10, 4, 0])
            pages.append((at, length, length == 10 or rng.random() < 0.6))
            at += length
        if rng.random() < 0.4:
            pages.pop(rng.randrange(len(pages)))
        if rng.random() < 0.2:
            pages.append((rng.choice([0, 5, 10, 20, 24]), rng.choice([0, 4, 10]), False))
        if pages:
            sets[f"layer{number}"] = pages
    rows = [(name, *page) for name, pages in sets.items() for page in pages]
    states = page_status(spark.createDataFrame(rows, PAGES), 10).collect()
    found = {row.layer: row.status for row in states}
    assert found == {name: scan(pages, 10) for name, pages in sets.items()}
    assert len(set(found.values())) == 4


def test_any_split_of_a_layer_is_complete(spark):
    rng = random.Random(7)
    rows = []
    for layer in range(50):
        at = 0
        for _ in range(rng.randint(0, 6)):
            length = rng.randint(1, 10)
            rows.append((str(layer), at, length, True))
            at += length
        rows.append((str(layer), at, rng.randint(0, 9), False))
    found = page_status(spark.createDataFrame(rows, PAGES), 10)
    assert found.where("status <> 'complete'").count() == 0


@pytest.mark.parametrize("rows_each", [2500, 600, 100])
def test_rank_with_a_hot_group(spark, rows_each):
    rng = random.Random(3)
    keys = rng.sample(range(-10**12, 10**12), 3000) + list(range(2000))
    rows = [(key, "hot" if i % 3 else f"g{i % 7}") for i, key in enumerate(keys)]
    frame = spark.createDataFrame(rows, "id BIGINT, layer STRING").repartition(7)
    found = {r.id: r.rank for r in rank_rows(frame, "id", ["layer"], rows_each).collect()}
    expected = {}
    for layer in {layer for _, layer in rows}:
        ids = sorted(key for key, own in rows if own == layer)
        expected.update({key: place for place, key in enumerate(ids)})
    assert found == expected


def test_rank_without_rows_or_with_one(spark):
    assert rank_rows(spark.createDataFrame([], "id BIGINT"), "id").count() == 0
    one = spark.createDataFrame([(5,)], "id BIGINT")
    assert [tuple(row) for row in assign_pages(one, "id").collect()] == [(5, 0, 0)]


def test_rank_keeps_missing_keys_and_groups(spark):
    rows = [(None, "a"), (3, "a"), (1, None), (2, None), (None, None), (5, "a")]
    frame = spark.createDataFrame(rows, "id BIGINT, layer STRING")
    found = {(r.id, r.layer): r.rank for r in rank_rows(frame, "id", ["layer"]).collect()}
    assert found == {
        (None, "a"): 0, (3, "a"): 1, (5, "a"): 2, (None, None): 0, (1, None): 1, (2, None): 2,
    }
    ranks = {r.rank for r in rank_rows(frame.where("layer IS NULL"), "id").collect()}
    assert ranks == {0, 1, 2}


def test_page_slice_at_any_offset(spark):
    frame = spark.range(5000).select((F.col("id") * 3).alias("id"), F.lit(1).alias("rank"))
    late = page_slice(frame, "id", 4500, 100)
    assert sorted(r.id for r in late.collect()) == [3 * k for k in range(4500, 4600)]
    assert page_slice(frame, "id", 4990, None).count() == 10
    plan = late._jdf.queryExecution().toString()
    assert "CollectLimit" not in plan and "TakeOrdered" not in plan
    assert "Window" not in plan.split("Physical Plan")[-1]


KEYS = {
    "BIGINT": [None, *range(-40, 60)],
    "STRING": [None, "", "\u00e9", "Z", "a", "a b", "\U0001f600", *(f"k{n}" for n in range(90))],
    "DATE": [datetime.date(2020, 1, 1) + datetime.timedelta(days=3 * n) for n in range(80)],
    "DOUBLE": [None, -0.5, 0.25, float("inf"), float("nan"), *(n / 3 for n in range(1, 70))],
}


@pytest.mark.parametrize("kind", KEYS)
def test_directory_gives_every_page_of_keys_of_any_type(spark, kind):
    keys = KEYS[kind]
    frame = spark.createDataFrame([(key, at) for at, key in enumerate(keys)], f"`a key` {kind}, rank INT")
    in_order = [row.rank for row in frame.orderBy(frame["a key"].asc_nulls_first()).collect()]
    directory = page_directory(frame, "a key", bucket_rows=9).cache()
    assert directory.count() > 5
    for offset, limit in [(0, 1), (0, 17), (8, 2), (9, 9), (33, 30), (len(keys) - 1, 5), (len(keys), 5), (3, 0), (50, None)]:
        page = page_between(frame, "a key", directory, offset, limit)
        end = None if limit is None else offset + limit
        assert sorted(row.rank for row in page.collect()) == sorted(in_order[offset:end]), (offset, limit)


def test_page_of_keys_with_many_rows_holds_all_their_rows(spark):
    frame = spark.range(3000).select((F.col("id") % 30).alias("id"), F.col("id").alias("row"))
    hot = frame.union(spark.range(1000).select(F.lit(7), F.col("id") + 3000))
    page = page_slice(hot, "id", 5, 4, distinct=True, bucket_rows=10).groupBy("id").count()
    assert {row["id"]: row["count"] for row in page.collect()} == {5: 100, 6: 100, 7: 1100, 8: 100}


def test_page_of_an_empty_table(spark):
    assert page_slice(spark.createDataFrame([], "id BIGINT"), "id", 0, 10).count() == 0


def test_page_reaches_the_scan_as_a_key_range(spark, tmp_path):
    spark.range(10_000).write.parquet(str(tmp_path / "t"))
    page = page_slice(spark.read.parquet(str(tmp_path / "t")), "id", 4_000, 50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,4000)" in plan and "LessThanOrEqual(id,4049)" in plan
    assert "Exchange" not in plan
    assert page.count() == 50
