"""Facts of landed pages, taken once when a page lands and stored.

Page bodies are large and parsing them is most of the work on them. A run takes the landed files that no
run has seen, parses their bodies and appends one short row per page. Page-set status, triage and the
re-fetch list are then read from these rows; only the build of a layer parses bodies again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.schemas import PAGE_FACTS
from embergrid.sources.landed_pages import page_measures
from embergrid.streaming.landed_stream import append_layer, stream_landed_pages


def facts_of(pages: DataFrame) -> DataFrame:
    """One row per landed page, good or not; length and flag are NULL for a page that is not ``ok``."""
    good = F.col("outcome") == "ok"
    return page_measures(pages).select(
        "layer",
        "result_offset",
        "http_status",
        "outcome",
        "retryable",
        "message",
        F.when(good, F.col("page_len")).alias("page_len"),
        F.when(good, F.col("exceeded")).alias("exceeded"),
    )


def record_facts(spark: SparkSession, landed: str, path: str, file_format: str = "parquet") -> None:
    """Appends the facts of the files in ``landed`` that have none yet.

    The stream's checkpoint under ``path`` knows the files, so each counts exactly once, also when a run
    breaks off and is started again. Files must land whole and stay as they are. One run at a time.
    """
    pages = stream_landed_pages(spark, landed, file_format)
    append_layer(pages, facts_of, f"{path}/facts", f"{path}/checkpoint").awaitTermination()


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """All facts recorded so far, those of whole runs only."""
    return spark.read.schema(PAGE_FACTS).parquet(f"{path}/facts")
