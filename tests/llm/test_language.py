from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.llm import language_id
from embergrid.llm.common import read_table
from tests.llm.data import documents


def test_held_out_accuracy(spark, sf_dir):
    result = language_id.op6(spark, sf_dir)
    truth = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    right = result.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_awkward_rows(spark):
    texts = {"en": "the cat and the dog with this hat", "de": "der hund und die katze mit dem hut"}
    labelled = spark.createDataFrame([(t, l) for l, t in texts.items()] + [(None, "fr"), ("x", None)], "text string, lang string")
    prototypes = language_id.learn(labelled)
    assert set(prototypes) == {"de", "en"}
    rows = [(0, None), (1, ""), (2, "123 !?"), (3, "THE DOG AND THE CAT"), (4, "die katze und der hund"), (5, "z"), (6, "日本"), (3, "THE DOG AND THE CAT")]
    df = spark.createDataFrame([(n, t, "x", 0.1) for n, t in rows], "doc_id int, text string, lang_pred string, score double")
    found = [tuple(row) for row in language_id.predict(df, prototypes).orderBy("doc_id").collect()]
    assert [row[1] for row in found[:3]] == ["und"] * 3 and [row[2] for row in found[:3]] == [0.0] * 3
    assert [row[1] for row in found[3:6]] == ["en", "en", "de"]
    assert all(0 <= row[2] <= 1 for row in found) and found[6][1] in prototypes


def test_nothing_to_learn_from_and_empty_table(spark):
    prototypes = language_id.learn(documents(spark).where("lang = 'none'"))
    found = language_id.predict(documents(spark), prototypes).select("lang_pred", "score").distinct().collect()
    assert [tuple(row) for row in found] == [("und", 0.0)]
    assert language_id.predict(documents(spark, []), prototypes).collect() == []


def test_bundle_is_the_sum_of_bound_letters():
    profiles = language_id.Profiles(64, 1)
    grams = profiles.grams("Ab")
    assert len(grams) == 2
    first, second, third = profiles._places
    space, a, b = 0, 1, 2
    want = first[space] * second[a] * third[b] + first[a] * second[b] * third[space]
    assert (profiles.bundle(*np.unique(grams, return_counts=True)) == want).all()


def plain_profile(text, vectors):
    """Sum of the bound trigrams of a text by the stated rule, letter by letter."""
    line, before = [0], False
    for sign in text:
        lower = sign.lower()[0]
        point = ord(lower)
        if lower.isalpha():
            line.append(point - 96 if "a" <= lower <= "z" else 27 + point % 37)
        elif before:
            line.append(0)
        before = lower.isalpha()
    total = np.zeros(vectors.shape[1], np.int64)
    if any(line):
        line.append(0)
        for (a, b, c), n in Counter(zip(line, line[1:], line[2:])).items():
            total += n * vectors[a] * np.roll(vectors[b], 1) * np.roll(vectors[c], 2)
    return total


def test_every_document_equals_the_plain_rule(spark):
    sf_dir = "/root/testdata/sf0.001"
    vectors = np.random.default_rng(language_id.SEED).integers(0, 2, (64, language_id.DIMENSIONS), np.int8).astype(np.int64) * 2 - 1
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    profiles = [plain_profile(row.text or "", vectors) for row in rows]
    out = [zlib.crc32(str(row.doc_id).encode()) % 4 == 2 for row in rows]
    learned = {}
    for row, profile, held_out in zip(rows, profiles, out):
        if not held_out and row.text is not None and row.lang is not None:
            learned[row.lang] = learned.get(row.lang, 0) + profile
    found = {row.doc_id: (row.held_out, row.lang_pred, row.score) for row in language_id.op6(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for row, profile, held_out in zip(rows, profiles, out):
        scores = {"und": 0.0}
        if profile.any():
            length = math.sqrt(int(profile @ profile))
            scores = {lang: int(sums @ profile) / math.sqrt(int(sums @ sums)) / length for lang, sums in sorted(learned.items())}
        best = max(scores, key=scores.get)
        assert found[row.doc_id] == (held_out, best, pytest.approx(min(max(scores[best], 0.0), 1.0), abs=1e-6))
