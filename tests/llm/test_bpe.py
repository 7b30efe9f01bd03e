from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from embergrid.llm import byte_bpe
from tests.llm.data import awkward_rows, documents


@pytest.fixture(scope="module")
def coder():
    with open(byte_bpe.VOCABULARY, "rb") as file:
        return byte_bpe.ByteBpe(file.read())


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_awkward_rows_as_the_library_would(spark, library):
    got = sorted(tuple(row) for row in byte_bpe.digests(documents(spark)).where("doc_id IS NOT NULL").collect())
    want = []
    for row in awkward_rows():
        ids = library.encode_ordinary(row[1] or "")
        packed = np.array(ids, "<u4").tobytes()
        if row[0] is not None:
            want.append((row[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.digests(documents(spark, [])).collect() == []


def test_encode_and_decode_round_trip(spark):
    encoded = byte_bpe.encode(documents(spark), keep=("doc_id", "text"))
    back = byte_bpe.decode(encoded, keep=("doc_id",)).where("doc_id IS NOT NULL")
    texts = sorted((row["doc_id"], row["text"]) for row in back.collect())
    assert texts == sorted((row[0], row[1] or "") for row in awkward_rows() if row[0] is not None)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab c's \n\t\x0b\x1c\x85 .1"), st.characters(exclude_categories=["Cs"]))))
def test_any_text(coder, library, text):
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert "".join(coder.decode(ids)) == text


def test_random_tokens_in_one_piece(coder):
    # The transducer against the merges themselves, on pieces that are hard to cut.
    rng = random.Random(4)
    tokens = list(coder.merges.ranks)
    for _ in range(3000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))
        merged = [coder.merges.ranks[part] for part in coder.merges.merge(piece)]
        assert coder._transducer.encode(piece) == merged


def test_full_tables_start_anew(library):
    with open(byte_bpe.VOCABULARY, "rb") as file:
        coder = byte_bpe.ByteBpe(file.read(), tables=byte_bpe.Tables(3, 5, 2))
    text = "several unusual words xqzzt recombining xqzzt several wobblywords"
    for _ in range(2):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_utf8_stream_at_every_cut():
    data = "aé日🙂z".encode() + b"\xf0\x9f\x98" + b"\xed\xa0\x80" + b"\xc3"
    whole = data.decode("utf-8", "replace")
    for cut in range(len(data) + 1):
        stream = byte_bpe.Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.finish() == whole
    stream = byte_bpe.Utf8Stream()
    assert "".join(stream.feed(data[k : k + 1]) for k in range(len(data))) + stream.finish() == whole


def test_unknown_id_is_an_error(coder):
    with pytest.raises(ValueError):
        list(coder.decode(np.array([10**6], "<u4").tobytes()))
