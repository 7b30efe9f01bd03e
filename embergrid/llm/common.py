"""Small helpers shared by the operators: tables, the shared folder, table steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as the cluster names it.

    A local session without the setting gets a temporary folder; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="embergrid-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, lost tasks reread it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Bytes that a task exchanges with its Python worker at a time, where the session has Spark's default.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts do not add up; a session's own bound stays."""
    if spark.conf.get(_BATCH_SETTING) in ("64MB", "67108864b"):
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {name.lower() for name in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a task holds at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(
    batch: pa.RecordBatch, column: str, size: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``size`` bytes of text, with the text's bytes and the rows' offsets in them.

    Null text is empty; one text longer than that stays whole.
    """
    text = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    content = text.buffers()[2]
    data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        part = offsets[start : stop + 1]
        yield batch.slice(start, stop - start), data[part[0] : part[-1]], part - part[0]
        start = stop


def runs_inside(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each run of marked bytes; a run never goes over a row's end."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < inside.size)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(offsets, starts, side="right") - 1
