"""Queries of the operators and the pipeline, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from embergrid.llm import (
    byte_bpe,
    clustering,
    divergence,
    exact_dedup,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    sharding,
    token_files,
    topk_search,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": topk_search.op1,
    "op2_ngram_join": ngram_join.op2,
    "op3_sharding": sharding.op3,
    "op4_byte_bpe": byte_bpe.op4,
    "op5_url_filter": url_filter.op5,
    "op6_language_id": language_id.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_html_extract": html_extract.op8,
    "op9_token_files": token_files.op9,
    "op10_mixing": mixing.op10,
    "op11_line_dedup": line_dedup.op11,
    "op12_divergence": divergence.op12,
    "op13_clustering": clustering.op13,
}

ORACLE: dict[str, str] = {
    "op1_topk_search": topk_search.ORACLE_SQL,
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op3_sharding": sharding.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_line_dedup": line_dedup.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
    "op13_clustering": clustering.ORACLE_SQL,
}
