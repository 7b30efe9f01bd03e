"""JSON arrays read by byte ranges, against Python's own parser."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import PySparkException

from embergrid import fixed_values as fixed
from embergrid.sources import camera_feed
from embergrid.sources.camera_feed import feed_shapes, read_camera_feed
from embergrid.sources.json_ranges import array_chunks


@pytest.fixture(params=[48, 400, 1 << 20])
def ranges(spark, request):
    """Byte ranges of that size, so that a small file is read by many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(name) for name in names]
    for name, value in zip(names, (request.param, 1)):
        spark.conf.set(name, value)
    yield request.param
    for name, value in zip(names, old):
        spark.conf.set(name, value)


def value(rng, depth):
    kind = rng.randrange(9 if depth else 5)
    if kind < 3:
        return "".join(rng.choice('ab }{[],:"\\é\n🙂') for _ in range(rng.randrange(12)))
    if kind < 5:
        return rng.choice([None, True, 7, -1.5])
    if kind < 7:
        return [value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {f"k{rng.randrange(9)}{place}": value(rng, depth - 1) for place in range(rng.randrange(4))}


def array(seed):
    rng = random.Random(seed)
    items = [value(rng, 3) for _ in range(rng.randrange(40))]
    for number in range(rng.randrange(8)):
        items.insert(rng.randrange(len(items) + 1), {"name": f"c{number}", "site": {"id": number}, "x": value(rng, 3)})
    style = {"indent": rng.choice([None, 1])} if rng.random() < 0.5 else {"separators": (" , ", " : ")}
    return items, " \n" * rng.randrange(2) + json.dumps(items, ensure_ascii=rng.random() < 0.5, **style) + "\n" * rng.randrange(2)


BAD = [
    '{"a":[{"b":1}]}', '[{"a":1}] oops', '[{"a":1}],[2]', '[{"a":1}]]', '[{"a":1},]', '[{"a":1},,{"b":2}]',
    '[{"a":1} {"b":2}]', '[{"a":1},{"b":2}', '[{"a":"x}]', '[{"a":1}', '{"a":1}', "   ", "7", '[{"a":1}}]',
    '[,{"a":1}]', '[{"a":1}], {"b":2}]', '[{"a":1},] ', '[{"a":{"b":1}},{"c":tru}]', '}', '[{"a":1\\}]',
]


@pytest.mark.parametrize("chunk_bytes", [1, 100])
def test_arrays_as_the_plain_parser_reads_them(spark, ranges, tmp_path, chunk_bytes):
    want = {}
    for seed in range(25):
        items, text = array(seed)
        (tmp_path / f"a{seed}.json").write_text(text)
        want[f"a{seed}.json"] = items
    for number, text in enumerate(BAD):
        (tmp_path / f"b{number}.json").write_text(text)
        want[f"b{number}.json"] = None
    shapes = {row.file.rsplit("/", 1)[1]: (row.ok, row.error) for row in feed_shapes(spark, str(tmp_path), chunk_bytes).collect()}
    assert shapes == {
        name: (True, None) if items is not None else (False, fixed.CAMERA_PAYLOAD_ERROR) for name, items in want.items()
    }
    for number in range(len(BAD)):
        (tmp_path / f"b{number}.json").unlink()
    found = {name: [] for name, items in want.items() if items is not None}
    rows = array_chunks(spark, str(tmp_path), chunk_bytes).collect()
    for row in rows:
        found[row.file.rsplit("/", 1)[1]] += json.loads(row.chunk)
    assert {name: sorted(map(json.dumps, items)) for name, items in found.items()} == {
        name: sorted(map(json.dumps, items)) for name, items in want.items() if items is not None
    }
    records = sorted(str(row.name) for row in read_camera_feed(spark, str(tmp_path), chunk_bytes).collect())
    objects = [item for items in want.values() if items is not None for item in items if isinstance(item, dict)]
    assert records == sorted(str(item.get("name")) for item in objects)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        cameras = [{"name": f"camera {number}", "site": {"id": number, "state": "OR"}} for number in range(2000)]
        (tmp_path / "feed.json").write_text(json.dumps(cameras))
        records = read_camera_feed(spark, str(tmp_path), 8192)
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 8
        # No parsed text comes near the size of the file.
        monkeypatch.setattr(camera_feed, "PARSED_BYTES", 20_000)
        found = sorted((int(row.site.id), row.name) for row in records.collect())
        assert found == [(number, f"camera {number}") for number in range(2000)]
        sizes = [len(row.chunk) for row in array_chunks(spark, str(tmp_path), 8192).collect()]
        assert max(sizes) < 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_large_payload_column_has_an_error_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(camera_feed, "PARSED_BYTES", 70)
    rows = spark.createDataFrame([("[7, 8, 9" + "x" * 20,)], "payload STRING")
    with pytest.raises(PySparkException, match=camera_feed.PAYLOAD_SIZE_ERROR):
        camera_feed.camera_records(rows).collect()
    assert camera_feed.payload_shapes(rows, "payload").first().error == camera_feed.PAYLOAD_SIZE_ERROR
