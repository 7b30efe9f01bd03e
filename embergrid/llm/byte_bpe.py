"""Byte-level BPE encoding and decoding (operator 4).

Encoding is a finite-state transducer over bytes, compiled from the merges. A token sequence is what
the merges give exactly when every two neighbours are: no merge may join a part of one to a part of
the other before both are complete (``Merges.apart``). That makes a nondeterministic transducer
whose states are a place in the trie of tokens and the last token. It is determinised on demand: a
state is the set of readings still possible, each with the tokens it has not emitted yet, and a
token is emitted as soon as all readings agree on it. A reading lives no longer than the longest
token, which bounds the lookahead. Transitions and whole words are kept in tables of bounded size.

Decoding joins token bytes and passes them through an incremental UTF-8 state machine, which holds
back at most three bytes of an unfinished character.

Cases: null text counts as empty and gives no ids; ids outside the vocabulary raise an error; bytes
that are no UTF-8 decode to U+FFFD; extra columns are ignored; rows may repeat; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm.common import free_name, read_table, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")



@dataclass(frozen=True)
class Tables:
    """Entries that a worker keeps; results do not depend on it.

    A full table starts anew; words of the table before stay at hand. ``LARGE`` takes some 500 MB
    of a worker, ``SMALL`` some 150 MB.
    """

    words: int
    transitions: int
    pairs: int


LARGE = Tables(600_000, 500_000, 800_000)
SMALL = Tables(120_000, 100_000, 150_000)

# Rows that go back at a time.
OUTPUT_ROWS = 1_000

# Tokens that are decoded at a time.
DECODE_BLOCK = 1 << 16

_ROOT = 0
_NEVER = 1 << 62


class Merges:
    """Tokens with their ranks, and which tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int], tables: Tables = LARGE) -> None:
        self.ranks = ranks
        self.tables = tables
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._ends: dict[int, tuple[list, list]] = {}
        self._apart: dict[int, bool] = {}

    def merge(self, piece: bytes, below: int = _NEVER) -> list[bytes]:
        """Merges by rank, leftmost first, using ranks under ``below`` only."""
        parts = [piece[at : at + 1] for at in range(len(piece))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(found)
            if rank >= below:
                break
            at = found.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def ends(self, token: int) -> tuple[list, list]:
        """Parts at the left and at the right end of a token, each with the rank that absorbs it."""
        known = self._ends.get(token)
        if known is None:
            whole = self.tokens[token]
            left, right = [(whole, _NEVER)], [(whole, _NEVER)]
            for side, parts in ((0, left), (-1, right)):
                part = whole
                while len(part) > 1:
                    rank = self.ranks[part]
                    part = self.merge(part, rank)[side]
                    parts.append((part, rank))
            known = self._ends[token] = (left, right)
        return known

    def apart(self, one: int, two: int) -> bool:
        """Whether both tokens stay whole side by side.

        A merge across the border comes first when its rank is below that which absorbs the part
        on its left, or not above that of the part on its right (of equal ranks the leftmost wins).
        """
        known = self._apart.get(one << 32 | two)
        if known is None:
            ranks = self.ranks
            known = True
            for left, left_ends in self.ends(one)[1]:
                for right, right_ends in self.ends(two)[0]:
                    rank = ranks.get(left + right, _NEVER)
                    if rank < left_ends and rank <= right_ends and rank != _NEVER:
                        known = False
                        break
                if not known:
                    break
            if len(self._apart) >= self.tables.pairs:
                self._apart.clear()
            self._apart[one << 32 | two] = known
        return known


class Transducer:
    """Bytes to token ids, one deterministic step per byte."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        # The trie of tokens: ``node << 8 | byte`` to the next node.
        self._next: dict[int, int] = {}
        self._token_at = [-1]
        self._inner = [True]
        for token, rank in merges.ranks.items():
            # A token that its own merges do not give can only be a whole piece.
            if len(token) == 1 or merges.merge(token) == [token]:
                node = _ROOT
                for byte in token:
                    self._inner[node] = True
                    node = self._next.setdefault(node << 8 | byte, len(self._token_at))
                    if node == len(self._token_at):
                        self._token_at.append(-1)
                        self._inner.append(False)
                self._token_at[node] = rank
        self._restart()

    def _restart(self) -> None:
        # A state: the last emitted token (-1 at the start) and the readings, each with its tokens
        # not emitted yet and its place in the trie. The start has read nothing.
        start = (-1, (((), _ROOT),))
        self._numbers = {start: 0}
        self._states = [start]
        self._finals: list[tuple[int, ...]] = [()]
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, readings = self._states[number]
        following, token_at, inner = self._next.get, self._token_at, self._inner
        after = []
        whole = None
        agreed = _NEVER
        for held, node in readings:
            child = following(node << 8 | byte)
            if child is None:
                continue
            if inner[child]:
                after.append((held, child))
                if len(held) < agreed:
                    agreed = len(held)
            if whole is None:
                token = token_at[child]
                if token >= 0:
                    before = held[-1] if held else last
                    if before < 0 or self.merges.apart(before, token):
                        whole = (*held, token)
        if whole is None:
            raise ValueError("the vocabulary lacks a byte")
        # Emit what all readings agree on.
        agreed = min(agreed, len(whole))
        for held, _ in after:
            while held[:agreed] != whole[:agreed]:
                agreed -= 1
        after.append((whole, _ROOT))
        if agreed:
            out = whole[:agreed]
            state = (out[-1], tuple([(held[agreed:], node) for held, node in after]))
        else:
            out = ()
            state = (last, tuple(after))
        target = self._numbers.get(state)
        if target is None:
            target = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._finals.append(whole[agreed:])
        step = self._steps[number << 8 | byte] = target, out
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        exact = self.merges.ranks.get(piece)
        if exact is not None:
            return [exact]
        if len(self._steps) >= self.merges.tables.transitions:
            self._restart()
        steps, number, ids = self._steps.get, 0, []
        for byte in piece:
            step = steps(number << 8 | byte)
            if step is None:
                step = self._step(number, byte)
            number, out = step
            if out:
                ids += out
        ids += self._finals[number]
        return ids


class ByteBpe:
    """Texts to ids and back, with the words seen so far kept."""

    def __init__(
        self, vocabulary: bytes, pattern: str = public_tokenizers.PATTERN, tables: Tables = LARGE
    ) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.merges = Merges(ranks, tables)
        self._transducer = Transducer(self.merges)
        self._pattern = regex.compile(pattern)
        self._size = max(ranks.values()) + 1
        # Token bytes one after the other, with the start and length of each; length -1 is no token.
        tokens = [self.merges.tokens.get(rank) for rank in range(self._size)]
        self._lengths = np.array([-1 if token is None else len(token) for token in tokens])
        self._starts = np.cumsum(np.maximum(self._lengths, 0)) - np.maximum(self._lengths, 0)
        self._flat = np.frombuffer(b"".join(token or b"" for token in tokens), np.uint8)
        self._words: dict[str, bytes] = {}
        self._words_before: dict[str, bytes] = {}

    def _pieces(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self._pattern.findall(text):
            ids += self._transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No match of the pattern runs from other characters into a space, so a text without white
        space before a space falls apart there, and its words are looked up one by one.
        """
        if not text:
            return b""
        first, *words = text.split(" ")
        if words and (not first or first[-1].isspace()):
            return self._pieces(text)
        found = list(map(self._words.get, words))
        if None in found:
            last = len(words) - 1
            for at, ids in enumerate(found):
                if ids is None:
                    word = words[at]
                    if not word or (at < last and word[-1].isspace()):
                        # White space before a space: the words do not fall apart here.
                        return self._pieces(text)
                    found[at] = self._new_word(word)
        return self._pieces(first) + b"".join(found)

    def _new_word(self, word: str) -> bytes:
        ids = self._words.get(word) or self._words_before.get(word) or self._pieces(" " + word)
        if not word[-1].isspace():
            if len(self._words) >= self.merges.tables.words:
                self._words, self._words_before = {}, self._words
            self._words[word] = ids
        return ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; an id without a token is an error."""
        if not ids.size:
            return b""
        lengths = self._lengths[np.minimum(ids, self._size - 1)]
        if int(ids.max()) >= self._size or int(lengths.min()) < 0:
            raise ValueError("id outside the vocabulary")
        ends = np.cumsum(lengths)
        places = np.repeat(self._starts[ids] - (ends - lengths), lengths)
        places += np.arange(places.size)
        return self._flat[places].tobytes()

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text of the ids, block by block."""
        stream = Utf8Stream()
        numbers = np.frombuffer(ids, "<u4")
        for start in range(0, numbers.size, DECODE_BLOCK):
            yield stream.feed(self.decode_bytes(numbers[start : start + DECODE_BLOCK]))
        yield stream.finish()


def _utf8_states() -> list[dict[int, int]]:
    """Transitions of the UTF-8 state machine: state 0 is between characters.

    States 1 to 3 await that many free continuation bytes; 4 to 7 await one from a narrower range,
    which bars overlong forms, surrogates and code points beyond U+10FFFF.
    """
    free = range(0x80, 0xC0)
    states: list[dict[int, int]] = [{} for _ in range(8)]
    states[0] |= {byte: 0 for byte in range(0x80)}
    states[0] |= {byte: 1 for byte in range(0xC2, 0xE0)}
    states[0] |= {byte: 2 for byte in range(0xE0, 0xF0)} | {0xE0: 4, 0xED: 5}
    states[0] |= {byte: 3 for byte in range(0xF1, 0xF4)} | {0xF0: 6, 0xF4: 7}
    for state in (1, 2, 3):
        states[state] |= {byte: state - 1 for byte in free}
    states[4] |= {byte: 1 for byte in range(0xA0, 0xC0)}
    states[5] |= {byte: 1 for byte in range(0x80, 0xA0)}
    states[6] |= {byte: 2 for byte in range(0x90, 0xC0)}
    states[7] |= {byte: 2 for byte in range(0x80, 0x90)}
    return states


class Utf8Stream:
    """Incremental UTF-8: feed bytes cut anywhere, get the characters that are complete."""

    _STATES = _utf8_states()

    def __init__(self) -> None:
        self._held = b""

    def feed(self, data: bytes) -> str:
        data = self._held + data
        # Only the last three bytes can belong to an unfinished character.
        self._held = b""
        for start in range(max(0, len(data) - 3), len(data)):
            if data[start] >= 0xC0:
                state = 0
                for byte in data[start:]:
                    state = self._STATES[state].get(byte, -1)
                    if state <= 0:
                        break
                if state > 0:
                    data, self._held = data[:start], data[start:]
                    break
        return data.decode("utf-8", "replace")

    def finish(self) -> str:
        held, self._held = self._held, b""
        return held.decode("utf-8", "replace")


_coders: dict[tuple, ByteBpe] = {}


def _coder(vocabulary: bytes, pattern: str, tables: Tables = LARGE) -> ByteBpe:
    """The worker's coder for a vocabulary; it lives as long as the worker."""
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern, tables)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBpe(vocabulary, pattern, tables)
    return _coders[key]


def _read_vocabulary(spark: SparkSession, path: str):
    """The rank file, broadcast: its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _texts(column: pa.Array) -> Iterable[str]:
    for text in column:
        yield text.as_py() or ""


def encode(
    df: DataFrame,
    text_column: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str = VOCABULARY,
    pattern: str = public_tokenizers.PATTERN,
    tables: Tables = SMALL,
) -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""
    ranks = _read_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(*keep, F.col(text_column).cast("string").alias(free_name(df, "text_")))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern, tables)
        for batch in slices(batches, OUTPUT_ROWS):
            ids = [coder.encode(text) for text in _texts(batch.column(len(names)))]
            counts = [len(value) // 4 for value in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(counts, pa.int64())],
                [*names, "ids", "n_tokens"],
            )

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in names)
    return rows.mapInArrow(run, f"{kept}, ids binary, n_tokens bigint")


def decode(
    df: DataFrame,
    ids_column: str = "ids",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str = VOCABULARY,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``keep`` columns and ``text`` from ids; null ids give null text."""
    ranks = _read_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(*keep, F.col(ids_column).alias("_ids"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern, SMALL)
        for batch in slices(batches, OUTPUT_ROWS):
            ids = batch.column("_ids").to_pylist()
            texts = [None if value is None else "".join(coder.decode(value)) for value in ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(texts, pa.string())],
                [*names, "text"],
            )

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in names)
    return rows.mapInArrow(run, f"{kept}, text string")


def digests(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes in one pass."""
    ranks = _read_vocabulary(df.sparkSession, vocabulary)
    pattern = public_tokenizers.PATTERN
    rows = df.select(F.col("doc_id"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in slices(batches, OUTPUT_ROWS):
            counts, encoded, decoded = [], [], []
            for text in _texts(batch.column("_text")):
                ids = coder.encode(text)
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for block in coder.decode(ids):
                    digest.update(block.encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
