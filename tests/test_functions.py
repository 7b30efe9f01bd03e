"""Column functions on literal inputs, one case per row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from embergrid.functions.dates import date_text
from embergrid.functions.links import https_url, id_link, url_component
from embergrid.functions.numbers import finite_number, number_text, plain_text
from embergrid.functions.text import body_preview, first_text, joined_text, state_code
from embergrid.operators.classify import fire_class, fire_size


def values(spark, inputs, kind, expression):
    rows = [(index, value) for index, value in enumerate(inputs)]
    frame = spark.createDataFrame(rows, f"i INT, v {kind}")
    return [row[0] for row in frame.orderBy("i").select(expression).collect()]


NUMBERS = {
    "12": 12.0,
    " 12.5 ": 12.5,
    "-3": -3.0,
    "+4.": 4.0,
    ".5": 0.5,
    "1e3": 1000.0,
    "-1.5E-2": -0.015,
    "": None,
    " ": None,
    "12px": None,
    "1d": None,
    "1f": None,
    "NaN": None,
    "inf": None,
    "Infinity": None,
    "1e999": None,
    "0x10": None,
    "true": None,
    ".": None,
    "1,000": None,
}


def test_finite_number(spark):
    found = values(spark, [*NUMBERS, None], "STRING", finite_number(F.col("v")))
    assert found == [*NUMBERS.values(), None]


@pytest.mark.parametrize(
    ("digits", "cases"),
    [
        (
            2,
            {
                0.125: "0.13",
                -0.125: "-0.13",
                1.005: "1.01",
                1234567.891: "1,234,567.89",
                5.0: "5",
                0.0: "0",
                2.5: "2.5",
                float("nan"): None,
                float("inf"): None,
            },
        ),
        (0, {2.5: "3", 0.5: "1", 1.5: "2", -2.5: "-3", 1234.4: "1,234"}),
    ],
)
def test_number_text(spark, digits, cases):
    found = values(spark, list(cases), "DOUBLE", number_text(F.col("v"), digits))
    assert found == list(cases.values())


def test_plain_text(spark):
    cases = {
        90.0: "90",
        -12.5: "-12.5",
        0.0: "0",
        -0.0: "0",
        12345678.0: "12345678",
        12345678.5: "12345678.5",
        100000000.0: "100000000",
        0.0001: "0.0001",
        0.000012345: "0.000012345",
        1e20: "100000000000000000000",
        1e21: "1e+21",
        1.5e300: "1.5e+300",
        1.5e-7: "1.5e-7",
        float("inf"): None,
    }
    assert values(spark, list(cases), "DOUBLE", plain_text(F.col("v"))) == list(cases.values())


def test_first_text_skips_empties(spark):
    cases = {None: "Camera", "": "Camera", "North": "North", " ": " "}
    expression = first_text(F.col("v"), F.lit(""), F.lit("Camera"))
    assert values(spark, list(cases), "STRING", expression) == list(cases.values())


def test_joined_text(spark):
    frame = spark.createDataFrame(
        [("Lane", "OR"), ("", "OR"), ("Lane", None), ("", None), (None, "")], "a STRING, b STRING"
    )
    found = [row[0] for row in frame.select(joined_text(F.col("a"), F.col("b"))).collect()]
    assert found == ["Lane, OR", "OR", "Lane", None, None]


def test_state_code(spark):
    cases = {"US-OR": "OR", "OR": "OR", "": None, None: None, "AUS-OR": "AUS-OR", "us-OR": "us-OR"}
    assert values(spark, list(cases), "STRING", state_code(F.col("v"))) == list(cases.values())


def test_body_preview(spark):
    cases = {
        "  a \n\t b  ": "a b",
        "   ": None,
        "": None,
        None: None,
        "x" * 200: "x" * 160,
        chr(0xA0) + "a" + chr(0x2003) + chr(0xFEFF) + "b": "a b",
    }
    assert values(spark, list(cases), "STRING", body_preview(F.col("v"))) == list(cases.values())


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_date_text(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        epochs = {
            1700000000000: "Nov 14, 2023",
            0: "Jan 1, 1970",
            -1: "Dec 31, 1969",
            86399999: "Jan 1, 1970",
            86400000: "Jan 2, 1970",
            9000000000000000: None,
            None: None,
        }
        found = values(spark, list(epochs), "BIGINT", date_text(ms=F.col("v")))
        assert found == list(epochs.values())
        texts = {
            "2024-03-05": "Mar 5, 2024",
            "2024-03-05T23:30:00Z": "Mar 5, 2024",
            "2024-03-05T23:30:00-08:00": "Mar 6, 2024",
            "2024-03-05T23:30:00": "Mar 5, 2024",
            "3/5/2024": "Mar 5, 2024",
            "Mar 5, 2024": "Mar 5, 2024",
            "11/14/2023 10:00:00 AM": "Nov 14, 2023",
            "Tue, 14 Nov 2023 00:00:00 GMT": "Nov 14, 2023",
            "Nov 14 2023": "Nov 14, 2023",
            "Tue Nov 14 2023": "Nov 14, 2023",
            "2023/11/14": "Nov 14, 2023",
            "November 14, 2023 18:05": "Nov 14, 2023",
            "Nov. 14, 2023": "Nov 14, 2023",
            "14-Nov-2023": "Nov 14, 2023",
            "14 Nov. 2023": "Nov 14, 2023",
            "Sept 5, 2023": "Sep 5, 2023",
            "Tue Nov 14 2023 23:30:00 GMT-0800 (Pacific Standard Time)": "Nov 15, 2023",
            "Nov 14, 2023 23:30 GMT-0800": "Nov 15, 2023",
            "11/14/2023 01:00 +02:00": "Nov 13, 2023",
            "Tue, 14 Nov 2023 23:59:59 +0000": "Nov 14, 2023",
            "2024-03-05 23:30-0800": "Mar 6, 2024",
            "2024-02-30": None,
            "2/29/2023": None,
            "2024-02-29T24:00:00+00:00": "Mar 1, 2024",
            "2024": "Jan 1, 2024",
            "2024-03": "Mar 1, 2024",
            "2024 10:30": None,
            "13/1/2024": None,
            "Nov 14, 2023 13:00 PM": None,
            "Nov 14, 2023 12:10 am": "Nov 14, 2023",
            "=|2024|1|1||||": None,
            "Foo 14, 2023": None,
            "1700000000000": None,
            "soon": None,
            "10:30": None,
            "": None,
            None: None,
        }
        found = values(spark, list(texts), "STRING", date_text(text=F.col("v")))
        assert found == list(texts.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_https_url(spark):
    kept = [
        "https://a.example/x.jpg",
        "HTTPS://a.example",
        "https://a.example/a b[1].jpg?q=ü",
        "https://a.example:8443/x",
    ]
    dropped = ["http://a.example", "", None, "a.example", "https://", "ftp://a.example"]
    dropped.append("https://a b/")
    found = values(spark, kept + dropped, "STRING", https_url(F.col("v")))
    assert found == kept + [None] * len(dropped)


def test_url_component(spark):
    cases = {
        "a b": "a%20b",
        "a+b": "a%2Bb",
        "a/b?c=d&e": "a%2Fb%3Fc%3Dd%26e",
        "-_.!~*'()": "-_.!~*'()",
        "é": "%C3%A9",
    }
    assert values(spark, list(cases), "STRING", url_component(F.col("v"))) == list(cases.values())


def test_id_link(spark):
    cases = {"7": "p/7", "a b": "p/a%20b", "0": None, "": None, None: None}
    assert values(spark, list(cases), "STRING", id_link("p/", F.col("v"))) == list(cases.values())
    assert values(spark, [0, 7], "BIGINT", id_link("p/", F.col("v"))) == [None, "p/7"]


def test_fire_size(spark):
    cases = {
        None: 14, -5.0: 14, 0.0: 14, 0.99: 14, 1.0: 16, 9.99: 16, 10.0: 18, 100.0: 20, 999.9: 20,
        1000.0: 24, 10000.0: 28, 1e9: 28,
    }
    assert values(spark, list(cases), "DOUBLE", fire_size(F.col("v"))) == list(cases.values())
    ids = values(spark, list(cases), "DOUBLE", fire_class(F.col("v")))
    assert ids == [f"fire-marker-{size}" for size in cases.values()]


def test_fire_size_never_falls_with_acres(spark):
    acres = [value / 7 for value in range(0, 100000, 13)]
    sizes = values(spark, acres, "DOUBLE", fire_size(F.col("v")))
    assert sizes == sorted(sizes)
