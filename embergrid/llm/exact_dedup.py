"""Exact deduplication on an extendible-hash index (operator 7).

1. Every row gets the SHA-256 of its normalised text; the first bits are its key.
2. The directory maps the leading bits of a key to a bucket. It starts with one bucket; while one
   is overfull, the bucket splits on its next bit, and the directory doubles when it has no bit
   left. It is built from row counts per leading bits, at most ``2 ** max_depth`` numbers.
3. Equal texts within an Arrow batch are collapsed first, so a text with a third of all rows moves
   a few times, not once per row. The rest goes to the owner tasks of the buckets, in key order.
4. An owner walks its keys with one chain per key: each text is compared byte by byte with those in
   the chain, and either joins one or is appended. The chain ends become the index, files in the
   shared folder.
5. Rows look their group up by key and chain entry; keys with many rows are split over tasks.

Cases: null text counts as empty, and empty texts are equal to one another; a null id sorts before
all others; rows repeated with one id and text give a row each, of which at most one is kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm.common import read_table, shuffle_partitions, staged
from embergrid.operators.skew import hot_keys, join_split

KEY_BITS = 63
MAX_DEPTH = 14
BUCKET_ROWS = 1_000

# Columns of the working tables.
_ROWS = "id bigint, key bigint, sha binary, mark binary"
_ENTRIES = "bucket int, key bigint, text binary, id bigint, n bigint"
_INDEX = "key bigint, sha binary, chain int, keep_id bigint, group_size bigint"


def normalise(text: bytes) -> bytes:
    """Lower-cases A-Z only: ``bytes.lower`` leaves every other byte alone."""
    return text.lower()


def _key(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - bits)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [normalise(text or b"") for text in batch.column("text").cast(pa.binary()).to_pylist()]


def row_keys(docs: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """``id, key, sha, mark`` of every row of ``docs(id, text, mark)``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(text).digest() for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([_key(digest, bits) for digest in digests], pa.int64()),
                    pa.array(digests, pa.binary()),
                    batch.column("mark"),
                ],
                ["id", "key", "sha", "mark"],
            )

    return docs.mapInArrow(hashed, _ROWS)


def build_directory(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int]]:
    """Buckets as ``(local depth, leading bits)``, from row counts per ``depth`` leading bits.

    ``counts`` are those of the deepest directory in use. A bucket splits while it has more rows
    than ``capacity`` and bits are left; a bucket that one key fills stays overfull, and its key's
    rows are chained.
    """
    levels = [dict(counts)]
    for _ in range(depth):
        above: dict[int, int] = {}
        for prefix, rows in levels[-1].items():
            above[prefix >> 1] = above.get(prefix >> 1, 0) + rows
        levels.append(above)
    levels.reverse()
    done, open_buckets, global_depth = [], [0], 0
    while open_buckets:
        overfull = []
        for prefix in open_buckets:
            if global_depth < depth and levels[global_depth].get(prefix, 0) > capacity:
                overfull += [2 * prefix, 2 * prefix + 1]
            else:
                done.append((global_depth, prefix))
        # Doubling: the directory grows by one bit, and only overfull buckets use it.
        open_buckets, global_depth = overfull, global_depth + 1
    return sorted(done, key=lambda bucket: bucket[1] << (depth - bucket[0]))


def directory_slots(buckets: list[tuple[int, int]], depth: int) -> list[int]:
    """The doubled-out directory: bucket number of each of the ``2 ** depth`` slots."""
    slots = []
    for number, (local, _) in enumerate(buckets):
        slots += [number] * (1 << (depth - local))
    return slots


def _collapsed(docs: DataFrame, slots: list[int], depth: int, bits: int) -> DataFrame:
    """Distinct texts of each batch with their bucket, largest id and row count."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for row_id, text in zip(batch.column("id").to_pylist(), _texts(batch)):
                entry = found.setdefault(text, [None, 0])
                if entry[0] is None or (row_id is not None and row_id > entry[0]):
                    entry[0] = row_id
                entry[1] += 1
            keys = [_key(hashlib.sha256(text).digest(), bits) for text in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([slots[key >> (bits - depth)] for key in keys], pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.array(list(found), pa.binary()),
                    pa.array([entry[0] for entry in found.values()], pa.int64()),
                    pa.array([entry[1] for entry in found.values()], pa.int64()),
                ],
                ["bucket", "key", "text", "id", "n"],
            )

    return docs.mapInArrow(collapse, _ENTRIES)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: entries arrive in key order; a key's chain holds its distinct texts."""
    key: int | None = None
    chain: list[list] = []

    def index_rows(chains: list[tuple[int, list[list]]]) -> pa.RecordBatch:
        rows = [
            (owner, hashlib.sha256(text).digest(), place, keep, size)
            for owner, entries in chains
            for place, (text, keep, size) in enumerate(entries)
        ]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, kinds)],
            ["key", "sha", "chain", "keep_id", "group_size"],
        )

    for batch in batches:
        ended: list[tuple[int, list[list]]] = []
        columns = (batch.column(name).to_pylist() for name in ("key", "text", "id", "n"))
        for row_key, text, row_id, rows in zip(*columns):
            if row_key != key:
                if key is not None:
                    ended.append((key, chain))
                key, chain = row_key, []
            for entry in chain:
                if entry[0] == text:
                    if entry[1] is None or (row_id is not None and row_id > entry[1]):
                        entry[1] = row_id
                    entry[2] += rows
                    break
            else:
                chain.append([text, row_id, rows])
        yield index_rows(ended)
    if key is not None:
        yield index_rows([(key, chain)])


def exact_dedup(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_rows: int = BUCKET_ROWS,
    max_depth: int = MAX_DEPTH,
    key_bits: int = KEY_BITS,
    mark: Column | None = None,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    With ``mark``, a binary value of each row, also ``mark``: the smallest one of the rows that are
    repeated with one id and text.
    """
    spark = df.sparkSession
    docs = df.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(text_column).alias("text"),
        (F.lit(None).cast("binary") if mark is None else mark).alias("mark"),
    )
    depth = min(max_depth, key_bits)
    keyed = staged(row_keys(docs, key_bits), "dedup-keys")
    prefix = F.shiftright("key", key_bits - depth).cast("int")
    # At most 2 ** depth rows, however many documents there are.
    counts = {row[0]: row[1] for row in keyed.groupBy(prefix).count().collect()}
    slots = directory_slots(build_directory(counts, depth, bucket_rows), depth)
    owners = max(shuffle_partitions(spark), 1)
    index = (
        _collapsed(docs.drop("mark"), slots, depth, key_bits)
        .repartition(owners, "bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(_chained, _INDEX)
    )
    index = staged(index, "dedup-index")
    # Rows repeated with one id are counted, looked up once, and listed again.
    smallest = [] if mark is None else [F.min("mark").alias("mark")]
    rows = keyed.groupBy("id", "key", "sha").agg(F.count("*").alias("copies"), *smallest)
    hot = hot_keys(index.groupBy("key").agg(F.sum("group_size").alias("n")), sum(counts.values()))
    found = join_split(rows, index.withColumnRenamed("sha", "_sha"), ["key"], hot, F.col("id"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return (
        found.where(F.col("sha") == F.col("_sha"))
        .withColumn("copy", copy)
        .select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            *([] if mark is None else ["mark"]),
        )
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
  max(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
  sha256(norm) AS text_sha256
FROM texts
"""
