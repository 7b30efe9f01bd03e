"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding (operator 9).

A file set has two tables in one folder. ``ranks`` lists the ids by falling frequency, so common ids
get small ranks. ``blocks`` holds runs of whole documents in ascending order of id: the ranks, each
in one to four data bytes, and apart from them control bytes with two bits per rank that say how
many. Reading looks the control bytes up in a table of lengths, which gives the place of every rank
at once.

Tokens of a text are those of the tokenizers library. White space always ends a token, so texts are
cut there. Arrow numbers the words of a slice of texts, each distinct word is encoded once per worker,
as long as it stays in a table of bounded size, and one numpy gather writes the ids of all texts.

Cases: null text counts as empty, so its document has the end id alone; a null doc_id comes first;
rows repeated with one doc_id follow one another, ordered by their ids; special tokens in a text are
ordinary text; extra columns are ignored; an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embergrid.llm.common import new_path, read_table, runs_inside, shuffle_partitions, staged, text_slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
# Ids after which a block ends; a block holds whole documents.
BLOCK_IDS = 1 << 18
# Words and pieces that a worker keeps in each of two generations, and the longest ones it keeps.
WORDS_KEPT = 400_000
LONGEST_KEPT = 64
# Bytes of text whose words are numbered at a time.
SLICE_BYTES = 8 << 20

# Fixed by the tokenizer file: its pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BLOCK = (
    "part int, block int, ids_before bigint, n_ids bigint, doc_ids array<bigint>, "
    "counts array<int>, control binary, data binary"
)

# Bytes of each of the four ranks that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0D, 0x20]] = True


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below ``2 ** 32``."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    padded = np.zeros(-(-ranks.size // 4) * 4, np.uint8)
    padded[: ranks.size] = extra
    quads = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return np.bitwise_or.reduce(quads, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ranks."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    # Three bytes beyond the end may be read; the masks drop them.
    stored = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = stored[starts].astype(np.uint32)
    for place in (1, 2, 3):
        longer = np.flatnonzero(lengths > place)
        ranks[longer] |= stored[starts[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return ranks


def _byte_letters() -> dict[int, str]:
    """Letter of each byte in the vocabulary: printable ones stand for themselves, the others follow
    the 256 in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + at) for at, byte in enumerate(others)}


class Known:
    """Ids of strings, in two generations of bounded size: what is in use moves to the newer one."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.now.get, keys))
        if self.before and None in found:
            for at, ids in enumerate(found):
                if ids is None and (ids := self.before.get(keys[at])) is not None:
                    found[at] = self.now[keys[at]] = ids
        return found

    def add(self, keys: list[str], ids: list[bytes]) -> None:
        if len(self.now) >= WORDS_KEPT:
            self.now, self.before = {}, self.now
        self.now.update((key, value) for key, value in zip(keys, ids) if len(key) <= LONGEST_KEPT)


class WordCoder:
    """Ids of texts as little-endian unsigned 16-bit integers.

    Texts are cut at white space in the bytes of an Arrow column, and words are numbered by Arrow's
    dictionary, so each distinct word of a slice is looked up once and the ids of all texts are one
    gather. New words are cut into pieces, and new pieces are merged by the library.
    """

    def __init__(self, vocabulary: str) -> None:
        self._library = Tokenizer.from_str(vocabulary)
        self._library.encode_special_tokens = True
        if self._library.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self._merge = self._library.model.tokenize
        self._split = regex.compile(PIECES).findall
        self._words = Known()
        self._pieces = Known()

    def _library_ids(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        found = dict(zip(pieces, self._pieces.find(pieces)))
        new = [piece for piece, ids in found.items() if ids is None]
        for piece in new:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
            found[piece] = np.array([token.id for token in self._merge(letters)], "<u2").tobytes()
        self._pieces.add(new, [found[piece] for piece in new])
        return found

    def _learn_words(self, words: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for word in words:
            if max(word) < "̀" and word.isprintable():
                # Composed already and lower-cased alike everywhere: the pieces are known.
                low = word.lower()
                split.append([low] if low.isalpha() else self._split(low))
            else:
                split.append(None)
        known = self._learn_pieces(list({piece: None for pieces in split if pieces for piece in pieces}))
        return [
            self._library_ids(word)
            if pieces is None
            else known[pieces[0]]
            if len(pieces) == 1
            else b"".join([known[piece] for piece in pieces])
            for word, pieces in zip(words, split)
        ]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        found = self._words.find(words)
        missing = [at for at, ids in enumerate(found) if ids is None]
        if missing:
            new = [words[at] for at in missing]
            ids = self._learn_words(new)
            for at, value in zip(missing, ids):
                found[at] = value
            self._words.add(new, ids)
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: bytes = b"") -> pa.Array:
        """Ids of the texts in ``data``, cut at ``offsets``, each followed by ``end``."""
        inside = ~_WHITE[data]
        _, lengths, rows = runs_inside(inside, offsets)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), lengths.size, [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]
        ).dictionary_encode()
        distinct = words.dictionary.cast(pa.large_string()).to_pylist()
        ids = [*self.word_ids(distinct), end]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        starts = np.cumsum(sizes) - sizes
        texts = offsets.size - 1
        after = np.searchsorted(rows, np.arange(texts), side="right")
        order = np.insert(words.indices.to_numpy().astype(np.int64), after, len(distinct))
        used = sizes[order]
        upto = np.cumsum(used)
        places = np.repeat(starts[order] - (upto - used), used)
        places += np.arange(places.size)
        flat = np.frombuffer(b"".join(ids), "<u2")[places]
        # The ids of a text end with those of its end mark.
        bounds = np.concatenate([[0], upto[after + np.arange(texts)]]) * 2
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), texts, [None, pa.py_buffer(bounds), pa.py_buffer(flat)]
        ).cast(pa.binary())


_LETTERS = _byte_letters()
_coders: dict[str, WordCoder] = {}


def _coder(vocabulary: str) -> WordCoder:
    """The worker's coder for a vocabulary; it lives as long as the worker."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(vocabulary)
    return _coders[key]


def tokenize(df: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` with the end id, ids as little-endian unsigned 16-bit integers."""
    with open(vocabulary, encoding="utf-8") as file:
        # The vocabulary's size does not depend on the data.
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u2").tobytes()
    rows = df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text", SLICE_BYTES):
                ids = coder.encode(data, offsets, end)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id bigint, ids binary")


def rank_ids(tokens: DataFrame) -> DataFrame:
    """``id, n`` of every id in use: the driver reads at most one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id bigint, n bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Writes ``tokens(doc_id, ids)`` as a file set in ascending doc_id order."""
    spark = tokens.sparkSession
    counts = rank_ids(tokens).collect()
    by_rank = [row["id"] for row in sorted(counts, key=lambda row: (-row["n"], row["id"]))]
    ranked = [(rank, number) for rank, number in enumerate(by_rank)]
    spark.createDataFrame(ranked, "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = before = held = 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            control, data = pack(rank_of[np.concatenate(parts)])
            sizes = [ids.size for ids in parts]
            row = [part, number, before, held, docs, sizes, control, data]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            names = [field.split()[0] for field in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, kinds)], names
            )

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                parts.append(np.frombuffer(ids.as_py(), "<u2"))
                docs.append(doc)
                held += parts[-1].size
                if held >= block_ids:
                    yield block()
                    number, before, held = number + 1, before + held, 0
                    docs, parts = [], []
        if parts:
            yield block()

    (
        tokens.withColumn("_tie", F.xxhash64("ids"))
        .repartitionByRange(max(shuffle_partitions(spark), 1), "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie", "ids")
        .select("doc_id", "ids")
        .mapInArrow(blocks, _BLOCK)
        .write.parquet(f"{path}/blocks")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of a file set; ids as little-endian unsigned 32-bit integers."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([row["id"] for row in ranks], "<u4")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # One number per file part.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts: dict[int, int] = {}
    total = 0
    for row in sizes:
        starts[row["part"]] = total
        total += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(np.array(row["counts"], np.int64))
                first = starts[row["part"]] + row["ids_before"]
                parts = [part.tobytes() for part in np.split(ids, ends[:-1])]
                begins = first + np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begins, pa.int64()), pa.array(parts, pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def checksums(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of documents read from a file set."""
    return files.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = staged(tokenize(read_table(spark, sf_dir, "documents")), "token-ids")
    path = new_path(spark, "token-files")
    write_files(tokens, path)
    return checksums(read_files(spark, path))
