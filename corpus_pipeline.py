"""Corpus pipeline over ``documents``: stages written as Parquet, each reading what the last kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from embergrid.llm import stages
from embergrid.llm.common import read_table, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.language_stage),
    ("exact_dedup", stages.exact_dedup_stage),
    ("ngram_jaccard_join", stages.jaccard_stage),
    ("source_mixing", stages.mixing_stage),
    ("byte_bpe", stages.bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# SQL has no random letter vectors and no byte pair merges; tests compare with plain Python instead.
ORACLE_SQL = None
