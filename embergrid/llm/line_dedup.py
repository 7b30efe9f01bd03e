"""Line deduplication with a sharded minimal perfect hash (operator 11).

1. Every document gives the 128-bit hashes of its distinct line keys. Tasks add them up before they
   are shuffled, so a line of a third of all documents moves a few times per task.
2. The distinct hashes are dealt to shards of bounded size. A shard becomes one ``LineTable``: a
   minimal perfect hash of a few bits per key, which numbers the keys without gaps, and two arrays
   in that order, of 32-bit fingerprints and of counts cut at the threshold.
3. Documents probe the arrays. They send the hashes of their lines, packed per shard, to the task
   that reads the shard's table, and get back the hashes that stand in enough documents. Lines are
   never joined, and their texts never move apart from their documents.
4. Keys that hold more than ``1 / HEAD_SHARES`` of all (document, line) pairs, at most that many,
   make up one more table that every task has, so no shard is asked about them.

A document is a row. An answer only says which hashes are frequent, which holds for all documents, so
two rows that share an answer's key by chance still get right results.

Cases: null and empty texts are one empty line, whose key is too short to be dropped; a text whose
lines all go becomes empty; null and shared ids are rows like others; a line repeated in a document
counts once and goes everywhere; very long texts and lines are handled whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, shuffle_partitions, staged

MIN_DOCS = 10
MIN_CHARS = 1

# Distinct keys per shard, on average.
SHARD_KEYS = 65_536
# Keys with more than this part of all pairs go to every task; fewer pairs than the second number
# are never worth it.
HEAD_SHARES = 4_096
HEAD_LEAST = 1_000
# Distinct keys that a task adds up before it passes them on.
COUNTED_KEYS = 200_000

# Slots per key of a level, and the number of levels before the rest is kept as a sorted list.
_SLOTS_PER_KEY = 1.5
_LEVELS = 40

_COUNTS = "h1 bigint, h2 bigint, n bigint"
_MESSAGES = "shard bigint, kind int, payload binary"
_ANSWERS = "row bigint, line binary"
_KEPT = "doc_id bigint, n_lines bigint, n_dropped bigint, text binary"


def line_keys(text: bytes) -> list[bytes]:
    """Key of every line: white space stripped at both ends, A-Z lower-cased (``bytes`` rules)."""
    return [line.strip().lower() for line in text.split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    if min_chars <= 1:
        return len(key) >= min_chars
    return len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _pairs(hashes: bytes) -> np.ndarray:
    """Packed 16-byte hashes as rows of two words; the first has its top bit free."""
    words = np.frombuffer(hashes, np.dtype("<u8")).reshape(-1, 2).copy()
    words[:, 0] >>= np.uint64(1)
    return words


def _mixed(words: np.ndarray, seed: int) -> np.ndarray:
    """One well-mixed word per key and seed."""
    step = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = words[:, 0] + words[:, 1] * step + step
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LineTable:
    """Minimal perfect hash over distinct keys, with a fingerprint and a count per key.

    Level by level, keys that are alone in their slot of a bit array are placed there; the others go
    on to the next, smaller level. A key's number is the count of bits set before its own.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, cap: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        rest, base = np.arange(len(keys)), 0
        number = np.empty(len(keys), np.int64)
        for level in range(_LEVELS):
            if rest.size == 0:
                break
            size = -(-int(_SLOTS_PER_KEY * rest.size + 1) // 64) * 64
            slots = (_mixed(keys[rest], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slots, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.dtype("<u8"))
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((size, words, before, base))
            placed = alone[slots]
            number[rest[placed]] = self._numbers(self.levels[-1], slots[placed])
            base += int(placed.sum())
            rest = rest[~placed]
        # Keys that no level could place, in practice none: found by search.
        rest = rest[np.lexsort((keys[rest, 1], keys[rest, 0]))]
        self.tail = [tuple(key) for key in keys[rest].tolist()]
        number[rest] = base + np.arange(rest.size)
        self.base = base
        self.marks = np.empty(len(keys), np.uint32)
        self.marks[number] = self._fingerprints(keys)
        kind = np.uint8 if cap < 2**8 else np.uint32 if cap < 2**32 else np.uint64
        self.counts = np.empty(len(keys), kind)
        self.counts[number] = np.minimum(counts, cap)

    @staticmethod
    def _numbers(level: tuple[int, np.ndarray, np.ndarray, int], slots: np.ndarray) -> np.ndarray:
        _, words, before, base = level
        word, bit = slots >> 6, (slots & 63).astype(np.uint64)
        lower = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return base + before[word] + np.bitwise_count(lower)

    @staticmethod
    def _fingerprints(keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys, _LEVELS + 1) >> np.uint64(32)).astype(np.uint32)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 where no bit is set, any number for other unknown keys."""
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for place, level in enumerate(self.levels):
            if rest.size == 0:
                return found
            slots = (_mixed(keys[rest], place) % np.uint64(level[0])).astype(np.int64)
            hit = (level[1][slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
            found[rest[hit]] = self._numbers(level, slots[hit])
            rest = rest[~hit]
        if self.tail:
            numbers = {key: self.base + place for place, key in enumerate(self.tail)}
            found[rest] = [numbers.get(tuple(key), -1) for key in keys[rest].tolist()]
        return found

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, cut at the cap; 0 where the fingerprint is not the key's."""
        if not self.marks.size:
            return np.zeros(len(keys), np.int64)
        number = self.numbers(keys)
        known = (number >= 0) & (self.marks[number] == self._fingerprints(keys))
        return np.where(known, self.counts[number], 0).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield text.as_py() or b""


def _distinct(text: bytes, min_chars: int) -> set[bytes]:
    return {line_hash(key) for key in set(line_keys(text)) if _long_enough(key, min_chars)}


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, n``: each distinct line hash and the number of documents it stands in."""

    def packed(found: Counter[bytes]) -> pa.RecordBatch:
        keys = _pairs(b"".join(found)).astype(np.uint64)
        columns = [keys[:, 0].view(np.int64), keys[:, 1].view(np.int64)]
        columns.append(np.fromiter(found.values(), np.int64, len(found)))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["h1", "h2", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in _texts(batch):
                found.update(_distinct(text, min_chars))
                if len(found) >= COUNTED_KEYS:
                    yield packed(found)
                    found = Counter()
        yield packed(found)

    partial = docs.select("text").mapInArrow(counted, _COUNTS)
    return partial.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _words(h1: pa.ChunkedArray, h2: pa.ChunkedArray) -> np.ndarray:
    columns = [column.to_numpy().view(np.uint64) for column in (h1, h2)]
    return np.stack(columns, axis=1)


def build_tables(counts: DataFrame, shards: int, cap: int) -> DataFrame:
    """One message per shard with its ``LineTable``."""

    def build(group: pa.Table) -> pa.Table:
        keys = _words(group.column("h1"), group.column("h2"))
        table = LineTable(keys, group.column("n").to_numpy(), cap)
        return pa.table(
            {
                "shard": pa.array([group.column("shard")[0].as_py()], pa.int64()),
                "kind": pa.array([0], pa.int32()),
                "payload": pa.array([pickle.dumps(table)], pa.binary()),
            }
        )

    dealt = counts.withColumn("shard", F.col("h1") % shards)
    return dealt.groupBy("shard").applyInArrow(build, _MESSAGES)


def _requests(docs: DataFrame, shards: int, head: LineTable, min_chars: int) -> DataFrame:
    """Messages that ask for the lines of documents: records of row key and hash, per shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_distinct(text, min_chars) for text in _texts(batch)]
            rows = np.repeat(batch.column("row").to_numpy(), [len(found) for found in lines])
            hashes = b"".join(line for found in lines for line in found)
            raw = np.frombuffer(hashes, np.dtype("<i8")).reshape(-1, 2)
            keys = _pairs(hashes)
            shard = (keys[:, 0] % np.uint64(shards)).astype(np.int64)
            asked = np.flatnonzero(head.counts_of(keys) == 0)
            asked = asked[np.argsort(shard[asked], kind="stable")]
            records = np.concatenate([rows[asked, None], raw[asked]], axis=1)
            ends = np.flatnonzero(np.diff(shard[asked])) + 1
            parts = [part for part in np.split(np.arange(asked.size), ends) if part.size]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard[asked[part[0]]] for part in parts], pa.int64()),
                    pa.array([1] * len(parts), pa.int32()),
                    pa.array([records[part[0] : part[-1] + 1].tobytes() for part in parts], pa.binary()),
                ],
                ["shard", "kind", "payload"],
            )

    return docs.select("row", "text").mapInArrow(ask, _MESSAGES)


def _answered(min_docs: int):
    """Owner task: messages arrive by shard, its table first. Holds one table at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: LineTable | None = None
        for batch in batches:
            rows, lines = [np.empty(0, np.int64)], []
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload")):
                if kind == 0:
                    table = pickle.loads(payload.as_py())
                    continue
                records = np.frombuffer(payload.as_py(), np.dtype("<i8")).reshape(-1, 3)
                hashes = np.ascontiguousarray(records[:, 1:])
                # The table has every key of these documents, so there always is one before.
                frequent = table.counts_of(_pairs(hashes.tobytes())) >= min_docs
                rows.append(records[frequent, 0])
                lines += [line.tobytes() for line in hashes[frequent]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(rows)), pa.array(lines, pa.binary())], ["row", "line"]
            )

    return run


def _dropping(head: LineTable, min_docs: int, min_chars: int):
    """Drops the frequent lines: those answered for the document, and those of the head table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, dropped, texts = [], [], []
            for text, answer in zip(_texts(batch), batch.column("lines")):
                frequent = set(answer.as_py() or ())
                lines, keys = text.split(b"\n"), line_keys(text)
                hashes = [line_hash(key) if _long_enough(key, min_chars) else None for key in keys]
                usable = list({line for line in hashes if line is not None} - frequent)
                common = head.counts_of(_pairs(b"".join(usable))) >= min_docs
                frequent.update(usable[place] for place in np.flatnonzero(common))
                kept = [line for line, key in zip(lines, hashes) if key not in frequent]
                numbers.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(numbers, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(texts, pa.binary()),
                ],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )

    return run


def drop_frequent_lines(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    shard_keys: int = SHARD_KEYS,
    head_least: int = HEAD_LEAST,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row, without lines of ``min_docs`` documents.

    ``n_lines`` is the number of lines before. Runs jobs for the counts before the result is asked
    for; counts and tables are written to the shared folder.
    """
    spark = df.sparkSession
    docs = df.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    counts = staged(line_counts(docs, min_chars), "line-counts")
    keys, pairs = counts.agg(F.count("*"), F.sum("n")).first()
    shards = max(1, -(-keys // shard_keys))
    # Fewer than HEAD_SHARES keys can have so large a part.
    hot = counts.where(F.col("n") > max((pairs or 0) // HEAD_SHARES, head_least)).collect()
    head = LineTable(
        np.array([(row["h1"], row["h2"]) for row in hot], np.int64).reshape(-1, 2).view(np.uint64),
        np.array([row["n"] for row in hot], np.int64),
        min_docs,
    )
    tables = staged(build_tables(counts, shards, min_docs), "line-tables")
    answers = (
        tables.unionByName(_requests(docs, shards, head, min_chars))
        .repartition(max(shuffle_partitions(spark), 1), "shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(_answered(min_docs), _ANSWERS)
        .groupBy("row")
        .agg(F.collect_set("line").alias("lines"))
    )
    return (
        docs.join(answers.hint("merge"), "row", "left")
        .select("doc_id", "text", "lines")
        .mapInArrow(_dropping(head, min_docs, min_chars), _KEPT)
        .withColumn("text", F.col("text").cast("string"))
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split
),
keyed AS (
  SELECT *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text, count(*) AS n
  FROM keyed WHERE key NOT IN (SELECT key FROM frequent) GROUP BY doc_id
)
SELECT split.doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped,
  sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id
"""
