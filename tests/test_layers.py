"""Landed files to published layers, sinks and the stream of landed pages."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException, SparkRuntimeException
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.operators.cards import burn_cards, camera_cards, fire_cards, fire_union
from embergrid.operators.features import in_bounds
from embergrid.operators.spatial import clip_points, points_in_polygons
from embergrid.plans.layers import (
    IncompletePages,
    MissingBoundary,
    as_features,
    burn_layer,
    edges_of,
    features_union,
    is_data_error,
    layer_groups,
    layer_versions,
    loaders,
    publish_layers,
    read_layers,
    read_visible_features,
    require_complete,
    visible_features,
)
from embergrid.schemas import FEATURES, LANDED_PAGE, LAYERS, empty_frame
from embergrid.sources.camera_feed import camera_records, feed_shapes, read_camera_feed
from embergrid.sources.landed_pages import read_landed_pages
from embergrid.sources import versions
from embergrid.sources.sinks import read_features, read_geojson_lines, write_features, write_geojson_lines
from embergrid.streaming.landed_stream import append_layer, stream_landed_pages
from embergrid.streaming.page_facts import read_facts, record_facts

CAMERAS = [
    {
        "name": "", "source": "North", "position": {"pan": 90.0}, "image": {"url": "https://i/1"},
        "site": {"id": 7, "state": "or", "latitude": "44.1", "longitude": -121.3, "county": "Lane"},
    },
    {"name": "No place", "site": {"id": "b", "state": "OR", "latitude": "x", "longitude": 1}},
    {"name": "Other", "site": {"id": "c", "state": "WA", "latitude": 46, "longitude": -120}},
    {"name": "No site"},
]


def feature(number, geometry, **properties):
    return {"type": "Feature", "id": number, "geometry": geometry, "properties": properties}


def point(lon, lat):
    return {"type": "Point", "coordinates": [lon, lat]}


def square(lon, lat, half):
    ring = [[lon + dx * half, lat + dy * half] for dx, dy in
            ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    return {"type": "Polygon", "coordinates": [ring]}


FIRES = [
    feature(1, point(-121, 44), IncidentName="Ash", IncidentSize=1234.5, PercentContained=12.6,
            POOCounty="Lane", POOState="US-OR"),
    feature(2, point(-120, 44), IncidentName="", IncidentSize="", POOState="US-OR"),
    feature(3, point(-120, 47), IncidentName="Away", POOState="US-WA"),
]
PERIMETERS = [
    feature(1, square(-121, 44, 0.5), poly_IncidentName="Ash", poly_GISAcres=99.999,
            attr_POOState="US-OR"),
]
BURNS = [
    feature(1, {"type": "MultiPoint", "coordinates": [["-121.5", "43.5"]]}, name="Spring",
            prescribed_date_start=1700000000000, watchduty_url="https://b/1", acreage="40.5"),
    feature(2, point(-121, 43), name=None, prescribed_date_start="2024-03-05"),
    feature(3, point(-110, 43), name="Far"),
    feature(4, point(-121, 43), name="Quoted", prescribed_date_start="1700000000000"),
]
BOUNDARY = [
    feature(10, square(-118, 48, 2), STATE="53", GEOID="53"),
    feature(11, square(-120.5, 44, 2), STATE="41", GEOID="41"),
    feature(12, point(0, 0), STATE="41", GEOID="41"),
]


def page(layer, offset, features, exceeded=False, status=200):
    body = json.dumps({"features": features, "exceededTransferLimit": exceeded})
    return layer, offset, status, body


def landed_pages():
    return [
        page("fires", 0, FIRES[:2], exceeded=True),
        page("fires", 2, FIRES[2:]),
        ("fires", 2, 503, "<html>"),
        page("fires", 3, FIRES),
        page("perimeters", 0, PERIMETERS),
        page("burns", 0, BURNS),
        page("boundary", 0, BOUNDARY),
    ]


@pytest.fixture
def landed(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "one.json").write_text(" \n" + json.dumps(CAMERAS))
    (feed / "two.json").write_text("[]")
    pages = str(tmp_path / "pages")
    spark.createDataFrame(landed_pages(), LANDED_PAGE).write.parquet(pages)
    return feed, pages, str(tmp_path / "layers")


def test_publish_reads_and_classifies_every_layer(spark, landed):
    feed, pages, out = landed
    status = publish_layers(spark, loaders(spark, str(feed), read_landed_pages(spark, pages)), out)
    assert {row.layer: (row.ok, row.error, row.rows) for row in status.collect()} == {
        "cameras": (True, None, 1),
        "fires": (True, None, 2),
        "perimeters": (True, None, 1),
        "burns": (True, None, 3),
        "boundary": (True, None, 2),
    }
    layers = read_layers(spark, out)
    camera = layers["cameras"].first()
    assert (camera.id, camera.name, camera.state, camera.lon) == ("7", "North", "or", -121.3)
    card = camera_cards(layers["cameras"]).first()
    assert (card.pan_text, card.image_url) == ("Pan: 90°", "https://i/1")
    assert card.feed_url == fixed.CAMERA_LINK_PREFIX + "7"

    cards = fire_cards(fire_union(layers["fires"], layers["perimeters"])).collect()
    assert sorted(map(tuple, cards), key=str) == sorted(
        [
            ("Ash", "1,234.5 acres", "13% contained", "Lane, OR"),
            ("Fire", None, None, "OR"),
            ("Ash", "100 acres", None, "OR"),
        ],
        key=str,
    )
    cards = {row.title: (row.acres_text, row.schedule_text, row.link_url)
             for row in burn_cards(layers["burns"]).collect()}
    assert cards == {
        "Spring": ("40.5 target acres", "Scheduled: Nov 14, 2023", "https://b/1"),
        "Prescribed fire": (None, "Scheduled: Mar 5, 2024", None),
        "Quoted": (None, None, None),
    }
    kinds = {row.oid: row.kind for row in layers["boundary"].collect()}
    assert kinds == {0: "outside", 1: "oregon"}

    edges = edges_of(layers["perimeters"], "feature_id", 3, 0.01)
    fires = layers["fires"].withColumnRenamed("feature_id", "fire")
    hits = points_in_polygons(fires, edges, "fire", geom_id="feature_id")
    assert [tuple(row) for row in hits.collect()] == [("1", "1")]
    outside = edges_of(layers["boundary"].where("kind = 'outside'"), "oid", 5, 0.002)
    kept = clip_points(layers["fires"], outside, "feature_id", geom_id="oid")
    assert sorted(row.feature_id for row in kept.collect()) == ["1", "2"]


BROKEN = {
    "cameras": ("two.json", '{"message":"down"}', fixed.CAMERA_PAYLOAD_ERROR),
    "fires": (2, (404, "gone"), "ArcGIS returned invalid JSON (HTTP 404): gone"),
    "burns": (0, (200, '{"features":[],"exceededTransferLimit":true}'), fixed.NOT_ADVANCED_ERROR),
    "boundary": (0, (200, json.dumps({"features": BOUNDARY[:1]})), fixed.BOUNDARY_MISSING_ERROR),
    "perimeters": (0, (200, json.dumps({"error": {"message": "no"}})), "no"),
}


@pytest.mark.parametrize("layer", BROKEN)
def test_one_broken_layer_leaves_the_others(spark, landed, layer, tmp_path):
    feed, _, out = landed
    where, what, message = BROKEN[layer]
    rows = landed_pages()
    if layer == "cameras":
        (feed / where).write_text(what)
    else:
        rows = [row for row in rows if (row[0], row[1]) != (layer, where)]
        rows.append((layer, where, *what))
    pages = spark.createDataFrame(rows, LANDED_PAGE)
    status = publish_layers(spark, loaders(spark, str(feed), pages), out)
    for row in status.collect():
        assert row.ok == (row.layer != layer), (row.layer, row.error)
        assert (row.rows == 0) == (row.layer == layer)
        if not row.ok:
            assert message in row.error
    assert read_layers(spark, out)[layer].count() == 0


def test_publish_replaces_the_whole_layer(spark, tmp_path):
    out = str(tmp_path / "layers")
    burns = empty_frame(spark, LAYERS["burns"])
    row = ("1", "a", None, None, None, None, -120.0, 43.0, None)
    full = spark.createDataFrame([row], LAYERS["burns"])
    assert publish_layers(spark, {"burns": lambda: full}, out).first().rows == 1
    assert read_layers(spark, out)["burns"].count() == 1
    assert publish_layers(spark, {"burns": lambda: burns}, out).first().rows == 0
    assert read_layers(spark, out)["burns"].count() == 0
    # A layer can be published from itself.
    doubled = [lambda: full, lambda: read_layers(spark, out)["burns"].union(full)]
    for load in doubled:
        publish_layers(spark, {"burns": load}, out)
    assert read_layers(spark, out)["burns"].count() == 2
    assert [row.seq for row in layer_versions(spark, out).collect()] == [4]


def lost_executor():
    raise SparkRuntimeException("Job aborted: ExecutorLostFailure (executor 3 exited)")


def test_errors_that_are_no_data_errors_keep_the_last_version(spark, tmp_path):
    out = str(tmp_path / "layers")
    row = ("1", "a", None, None, None, None, -120.0, 43.0, None)
    full = spark.createDataFrame([row], LAYERS["burns"])
    fire = ("1", *[None] * 6, -120.0, 43.0, 1.0, None)
    fires = spark.createDataFrame([fire], LAYERS["fires"])
    publish_layers(spark, {"burns": lambda: full, "fires": lambda: fires}, out)

    @F.udf("bigint")
    def breaks(value):
        raise OSError("no space left on device")

    broken_write = spark.range(40, numPartitions=4).select(
        *[F.lit(value).cast(kind).alias(name) for (name, kind), value in zip(burn_columns(), row[:2])],
        F.when(F.col("id") == 35, breaks("id")).cast("bigint").alias("start_ms"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in burn_columns()[3:]],
    )
    for load in (lost_executor, lambda: broken_write):
        two = fires.union(fires)
        with pytest.raises(PySparkException):
            publish_layers(spark, {"burns": load, "fires": lambda: two}, out)
        layers = read_layers(spark, out)
        # The broken layer is as it was, the other one is new.
        assert [tuple(found) for found in layers["burns"].collect()] == [row]
        assert layers["fires"].count() == 2
    features = as_features(fires, "fires", "feature_id", ("acres",), "Point")
    table = str(tmp_path / "features")
    write_features(features, table, ["fires", "burns"])
    bad = features.withColumn("lon", breaks(F.lit(1)).cast("double"))
    with pytest.raises(PySparkException):
        write_features(bad, table, ["fires"])
    assert read_features(spark, table).count() == 1
    # A table that is read while it is replaced, and again after that.
    grown = read_features(spark, table)
    write_features(grown.union(grown), table, ["fires"])
    assert read_features(spark, table).count() == 2 and grown.count() == 1
    assert versions.superseded(spark, table, keep=1).count() == 0
    write_features(grown.where("false"), table, ["burns"])
    assert versions.superseded(spark, table, keep=1).count() == 1
    assert read_features(spark, table).count() == 2


def burn_columns():
    return [tuple(part.split(" ")) for part in LAYERS["burns"].split(", ")]


def test_only_named_errors_are_data_errors(spark):
    assert is_data_error(IncompletePages("x")) and is_data_error(MissingBoundary("x"))
    assert not is_data_error(ValueError("x")) and not is_data_error(SparkRuntimeException("x"))
    for text in ("raise_error('x')", "cast('a' AS int)", "no_such_column"):
        with pytest.raises(PySparkException) as caught:
            spark.range(1).selectExpr(text).collect()
        assert is_data_error(caught.value), text


def test_incomplete_pages_without_failed_page(spark):
    pages = spark.createDataFrame([page("fires", 0, FIRES, exceeded=True)], LANDED_PAGE)
    with pytest.raises(IncompletePages, match="unfinished"):
        require_complete(pages)
    with pytest.raises(IncompletePages, match="none landed"):
        require_complete(pages.where("false"))


def test_feed_shapes_name_the_bad_file(spark, landed):
    feed, _, _ = landed
    (feed / "bad.json").write_text('{"a": 1}')
    shapes = {row.file.rsplit("/", 1)[1]: row.ok for row in feed_shapes(spark, str(feed)).collect()}
    assert shapes == {"one.json": True, "two.json": True, "bad.json": False}
    with pytest.raises(PySparkException, match=fixed.CAMERA_PAYLOAD_ERROR):
        read_camera_feed(spark, str(feed)).collect()


def published(spark, landed):
    feed, pages, out = landed
    publish_layers(spark, loaders(spark, str(feed), read_landed_pages(spark, pages)), out)
    return features_union(read_layers(spark, out))


def test_feature_table_and_visibility(spark, landed, tmp_path):
    features = published(spark, landed)
    counts = {row.layer: row["count"] for row in features.groupBy("layer").count().collect()}
    assert counts == {"cameras": 1, "fires": 2, "perimeters": 1, "burns": 3, "boundary": 2}

    def shown(**visible):
        rows = visible_features(features, visible).select("layer").distinct()
        return {row.layer for row in rows.collect()}

    # The boundary is in no group, so nothing hides it.
    assert shown() == {"cameras", "boundary"}
    assert shown(fires=True) == {"cameras", "boundary", "fires", "perimeters"}
    assert shown(cameras=False, prescribed=True) == {"burns", "boundary"}
    assert layer_groups(spark).count() == 5

    path = str(tmp_path / "features")
    write_features(features, path, cluster=True)
    write_features(features.where("layer = 'fires'").limit(1), path, ["fires", "burns"])
    again = read_features(spark, path)
    counts = {row.layer: row["count"] for row in again.groupBy("layer").count().collect()}
    # A layer that failed or became empty does not keep its old rows.
    assert counts == {"cameras": 1, "fires": 1, "perimeters": 1, "boundary": 2}


def test_geojson_lines(spark, landed, tmp_path):
    path = str(tmp_path / "lines")
    write_geojson_lines(published(spark, landed), path)
    published_lines = read_geojson_lines(spark, path)

    def lines_of(layer):
        return [json.loads(row.value) for row in published_lines.where(F.col("layer") == layer).collect()]

    lines = lines_of("fires")
    by_id = {line["id"]: line for line in lines}
    assert by_id["1"]["geometry"] == {"type": "Point", "coordinates": [-121.0, 44.0]}
    assert by_id["1"]["properties"]["IncidentName"] == "Ash"
    assert by_id["1"]["properties"]["acres"] == 1234.5
    lines = lines_of("boundary")
    assert {line["geometry"]["type"] for line in lines} <= {"Polygon", "MultiPolygon"}
    lines = lines_of("perimeters")
    rings = lines[0]["geometry"]["coordinates"]
    assert rings[0][0] == rings[0][-1] and len(rings[0]) >= 4


def test_bounds_filter_reaches_the_scan(spark, landed, capsys):
    published(spark, landed)
    burns = read_layers(spark, landed[2])["burns"]
    in_bounds(burns).select("name").explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(lon,-124.7)" in pushed
    assert "LessThanOrEqual(lat,46.4)" in pushed
    assert "ReadSchema: struct<name:string,lon:double,lat:double>" in plan


def test_landed_pages_as_a_stream(spark, landed, tmp_path):
    _, pages, _ = landed
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = stream_landed_pages(spark, pages).where(F.col("layer") == "burns")
        append_layer(stream, burn_layer, out, checkpoint).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 3
    assert run() == 3
    later = [page("burns", 4, [feature(5, point(-120, 44), name="Late")])]
    spark.createDataFrame(later, LANDED_PAGE).write.mode("append").parquet(pages)
    assert run() == 4


def test_boundary_without_polygons_is_an_error(spark, landed):
    _, _, out = landed
    pages = spark.createDataFrame([page("boundary", 0, [])], LANDED_PAGE)
    load = {"boundary": loaders(spark, "unused", pages)["boundary"]}
    row = publish_layers(spark, load, out).first()
    assert not row.ok and fixed.BOUNDARY_MISSING_ERROR in row.error and row.rows == 0


def test_an_error_without_text_empties_one_layer(spark, landed):
    _, _, out = landed

    def bad():
        raise IncompletePages

    full = spark.createDataFrame([("1", "a", None, None, None, None, -120.0, 43.0, None)], LAYERS["burns"])
    status = publish_layers(spark, {"fires": bad, "burns": lambda: full}, out).collect()
    assert {row.layer: (row.ok, row.error, row.rows) for row in status} == {
        "fires": (False, "IncompletePages", 0),
        "burns": (True, None, 1),
    }


def test_camera_items_that_are_no_objects_are_skipped(spark):
    rows = [('[7, null, {"name":"a","position":{"pan":5}}, "x"]',), (" [] ",)]
    found = camera_records(spark.createDataFrame(rows, "payload STRING")).collect()
    assert [(row.name, row.position.pan) for row in found] == [("a", "5")]
    for bad in ("[1] oops", "[1],[2]", "[1]]", '{"a":1}', "", None):
        with pytest.raises(PySparkException, match=fixed.CAMERA_PAYLOAD_ERROR):
            camera_records(spark.createDataFrame([(bad,)], "payload STRING")).collect()


def test_group_table_of_the_caller_prunes_layers_at_run_time(spark, tmp_path):
    path = str(tmp_path / "features")
    features = spark.createDataFrame(
        [(layer, str(at), "Point", 0.0, 0.0, None, "{}", None) for layer in "abcd" for at in range(3)], FEATURES
    )
    write_features(features, path, list("abcde"))

    def shown(*groups):
        table = spark.createDataFrame(groups, "source STRING, visible BOOLEAN")
        return read_visible_features(spark, path, table)

    def layers(*groups):
        return {row["layer"] for row in shown(*groups).collect()}

    assert layers(("a", False), ("b", True)) == set("bcd")
    assert layers(("a", False), ("a", True), ("b", None), (None, False), ("x", False)) == set("acd")
    assert layers() == set("abcd")
    assert layers(*[(layer, False) for layer in "abcd"]) == set()
    rows = shown(("a", False), ("b", False))
    assert rows.columns == features.columns
    assert rows.count() == 6
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()


def test_stored_facts_take_each_landed_file_once_and_decide_as_bodies_do(spark, tmp_path):
    folder, path = str(tmp_path / "pages"), str(tmp_path / "facts")

    def land(*rows):
        spark.createDataFrame(rows, LANDED_PAGE).coalesce(1).write.mode("append").parquet(folder)
        record_facts(spark, folder, path)
        facts, pages = read_facts(spark, path), read_landed_pages(spark, folder)
        assert facts.count() == pages.count()
        return facts, pages

    def verdict(pages, facts):
        try:
            return require_complete(pages, 2, facts)
        except IncompletePages as error:
            return str(error)

    facts, pages = land(page("fires", 0, FIRES[:2], exceeded=True), ("fires", 2, 503, "<html>"))
    assert verdict(pages, facts) == verdict(pages, None) == "ArcGIS returned invalid JSON (HTTP 503): <html>"
    facts, pages = land(page("fires", 2, FIRES[2:]), ("fires", 9, None, None))
    # A whole set needs no page at all.
    assert verdict(None, facts) == verdict(pages, None) == 2
    record_facts(spark, folder, path)
    assert read_facts(spark, path).count() == 4
    row = read_facts(spark, path).where("outcome = 'invalid_json'").first()
    assert (row.result_offset, row.retryable, row.page_len, row.exceeded) == (2, True, None, None)
    layers = loaders(spark, "", pages.where("result_offset < 9"), facts)
    assert layers["fires"]().count() == 2


def test_properties_keep_the_types_they_were_sent_with(spark, landed, tmp_path):
    feed, pages, out = landed
    publish_layers(spark, loaders(spark, str(feed), read_landed_pages(spark, pages)), out)
    table = str(tmp_path / "features")
    write_features(features_union(read_layers(spark, out)), table)
    found = {(row.layer, row.feature_id): json.loads(row.properties) for row in read_features(spark, table).collect()}
    assert found["fires", "1"] == {
        "IncidentName": "Ash", "IncidentSize": 1234.5, "PercentContained": 12.6, "POOCounty": "Lane",
        "POOState": "US-OR", "acres": 1234.5,
    }
    assert found["fires", "2"] == {"IncidentName": "", "IncidentSize": "", "POOState": "US-OR"}
    assert found["burns", "2"] == {"name": None, "prescribed_date_start": "2024-03-05"}
    assert found["boundary", "1"] == {"STATE": "41", "GEOID": "41", "kind": "oregon"}
    assert found["cameras", "7"]["name"] == "North"

    size = F.try_variant_get("sent", "$.IncidentSize", "double")
    large = read_features(spark, table).where((F.col("layer") == "fires") & (size > 1000)).select("feature_id")
    assert [row.feature_id for row in large.collect()] == ["1"]
    plan = large._jdf.queryExecution().executedPlan().toString()
    # The scan reads the one property and has the comparison.
    assert "GreaterThan(sent.`0`,1000.0)" in plan and "variant" not in plan.split("ReadSchema")[1]


def test_derived_properties_do_not_replace_sent_ones(spark):
    rows = ['{"acres":7}', '{"a":"x}\\n{y"}', "{}", "null", "[1]", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "id INT, text STRING").select(
        "id", F.lit(1.5).alias("acres"), F.parse_json("text").alias("sent")
    )
    features = as_features(frame.withColumn("lon", F.lit(0.0)).withColumn("lat", F.lit(0.0)), "x", "id", (), "Point", ("acres",))
    found = [json.loads(row.properties) for row in features.orderBy("feature_id").collect()]
    assert found == [{"acres": 7}, {"a": "x}\n{y", "acres": 1.5}, *[{"acres": 1.5}] * 4]
