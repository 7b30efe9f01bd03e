"""Stateless layer transformations on a stream of landed pages.

Page completeness needs the whole page set and stays a batch job; everything per page or per
feature runs unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from embergrid.schemas import LANDED_PAGE


def stream_landed_pages(
    spark: SparkSession, path: str, file_format: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Landed response pages as a stream."""
    return (
        spark.readStream.schema(LANDED_PAGE)
        .format(file_format)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def append_layer(
    pages: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Runs a layer builder over the landed pages at hand and appends the rows, exactly once."""
    return (
        build(pages)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
