from __future__ import annotations

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from embergrid.llm import token_files
from embergrid.llm.common import new_path, read_table
from tests.llm.data import awkward_rows, documents


def through_files(spark, df, **options):
    path = new_path(spark, "test-token-files")
    token_files.write_files(token_files.tokenize(df), path, **options)
    return token_files.read_files(spark, path)


def library_ids(texts):
    library = Tokenizer.from_file(token_files.VOCABULARY)
    library.encode_special_tokens = True
    return [library.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID] for text in texts]


def test_awkward_rows_as_the_library_would(spark):
    rows = awkward_rows()
    for block_ids in (1, 1 << 18):
        found = token_files.checksums(through_files(spark, documents(spark), block_ids=block_ids)).collect()
        want = [(row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for row, ids in zip(rows, library_ids(row[1] for row in rows))]
        assert sorted((row["doc_id"] is not None, row["doc_id"], row["n_tokens"], row["ids_crc32"]) for row in found) == sorted((row[0] is not None, *row) for row in want)
        total = 0
        for row in sorted(found, key=lambda row: row["start"]):
            assert row["start"] == total
            total += row["n_tokens"]
        ids = [row["doc_id"] for row in sorted(found, key=lambda row: row["start"])]
        assert ids == sorted(ids, key=lambda number: (number is not None, number or 0))


def test_empty_table(spark):
    assert through_files(spark, documents(spark, [])).collect() == []


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_pack_round_trip(ranks):
    values = np.array(ranks, np.uint32)
    control, data = token_files.pack(values)
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.unpack(control, data, len(ranks)).tolist() == ranks


def coded(coder, texts):
    """Ids of texts by the coder, all in one slice."""
    parts = [text.encode() for text in texts]
    offsets = np.cumsum([0, *map(len, parts)])
    end = np.array([token_files.END_ID], "<u2").tobytes()
    found = coder.encode(np.frombuffer(b"".join(parts), np.uint8), offsets, end)
    return [np.frombuffer(ids.as_py(), "<u2").tolist() for ids in found]


def word_coder():
    with open(token_files.VOCABULARY, encoding="utf-8") as file:
        return token_files.WordCoder(file.read())


def test_words_as_the_library_would():
    rng = random.Random(3)
    alphabet = "aabcdeéü \n\t  ''s.,;!?0129ABCñßç日本\x1c\x85  é🙂ΣσςİIı<|endoftext|>\xadªº²½"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    coder = word_coder()
    assert coded(coder, texts) == library_ids(texts)
    assert coded(coder, []) == [] and coded(coder, ["", " "]) == library_ids(["", " "])


def test_whole_table_as_the_library_would(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").where("length(text) < 20000")
    rows = sorted((row["doc_id"], row["text"]) for row in docs.collect())
    found = token_files.checksums(through_files(spark, docs)).orderBy("doc_id").collect()
    want = [(number, zlib.crc32(np.array(ids, "<u4").tobytes())) for (number, _), ids in zip(rows, library_ids(row[1] for row in rows))]
    assert [(row["doc_id"], row["ids_crc32"]) for row in found] == want


def test_full_tables_keep_results(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS_KEPT", 3)
    monkeypatch.setattr(token_files, "LONGEST_KEPT", 8)
    coder = word_coder()
    texts = ["several unusual words, recombining several words", "words words. wobbly 12 xqzt"]
    for _ in range(3):
        for text in texts:
            assert coded(coder, [text]) == library_ids([text])
