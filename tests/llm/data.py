"""Small documents with the awkward cases."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "id bigint, key string, c bigint, n bigint, a string, tokens string, weight double, bucket string, "
    "score string, lang_pred bigint, _text bigint, text_ string, _mark string, own_mark bigint, mark double, "
    "ids string, n_tokens string, listed_id string, row string, lines string"
)
CLASHING = (7, "k", 7, 7, "a", "t", 0.5, "b", "s", 1, 2, "x", "m", 3, 0.5, "i", "n", "l", "r", "l")

BASE = " ".join(f"w{number}" for number in range(60))


def near(text: str, changes: int, seed: int) -> str:
    """The text with some words exchanged."""
    words = text.split(" ")
    rng = random.Random(seed)
    for place in rng.sample(range(len(words)), changes):
        words[place] = f"x{seed}_{place}"
    return " ".join(words)


def awkward_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows, a hot source."""
    texts = [
        None,
        "",
        " \t\n",
        "one",
        "ONE",
        "one two three",
        "One two THREE",
        BASE,
        BASE.upper(),
        *[near(BASE, 1, seed) for seed in range(12)],
        *[near(BASE, 4, seed) for seed in range(20, 26)],
        " ".join(f"long{number}" for number in range(30_000)),
        "Ünïcödé ÄÖÜ straße İstanbul ΣΑΣ 日本語 🙂 é",
        "it's they'll  double  spaces\n\n and\ttabs \r\n 12 345",
        "12345 %%% !!!",
    ]
    rows = [
        (number, text, ("en", "de", None)[number % 3], ("src0", "src0", None, "src1")[number % 4], 5)
        for number, text in enumerate(texts)
    ]
    rows += [rows[3], rows[8], (None, "one", "en", "src0", 3), (None, None, None, None, None)]
    return [row + CLASHING for row in rows]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
