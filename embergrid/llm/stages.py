"""Pipeline stages: ``(spark, docs, sf_dir)`` to the documents that go on.

All but the last return the columns they were given, whatever their names. Ids may be null or shared
by different texts, so a document is found again by its id and its text's digest. Both together are
unique from the exact deduplication on, which also drops rows that repeat an id with one text.

Other cases: null and empty texts have no letter, so the language stage drops them; texts of any
length are read whole; an empty table gives an empty table. The last stage replaces ``text`` by the
columns ``ids`` and ``n_tokens``, and so do columns of these names that the documents bring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.llm import byte_bpe, language_id, mixing
from embergrid.llm.common import bound_batches, free_name, staged
from embergrid.llm.exact_dedup import exact_dedup
from embergrid.llm.ngram_join import component_heads

# Budget of the mix as a part of the tokens that reach it, in hundredths; each document at most once.
MIX_PERCENT = 80


def _mark() -> Column:
    """Digest of the text, null like empty, which tells rows with one id apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _only(docs: DataFrame, rows: DataFrame, id_column: str) -> DataFrame:
    """Documents whose id and mark are listed, with their own columns."""
    own, listed_id, listed_mark = (free_name(docs, stem) for stem in ("own_mark", "listed_id", "listed_mark"))
    listed = rows.select(F.col(id_column).alias(listed_id), F.col("mark").alias(listed_mark))
    same = F.col("doc_id").eqNullSafe(F.col(listed_id)) & (F.col(own) == F.col(listed_mark))
    return docs.withColumn(own, _mark()).join(listed, same, "left_semi").drop(own)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found stay (operator 6)."""
    bound_batches(spark)
    prototypes = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, prototypes)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (operator 7)."""
    bound_batches(spark)
    found = staged(exact_dedup(docs, mark=_mark()), "stage-dedup")
    kept = _only(docs, found.where("kept"), "doc_id")
    if found.where("doc_id <=> keep_id AND NOT kept").isEmpty():
        return kept
    # Of rows repeated with one id and text one stays.
    own = free_name(kept, "own_mark")
    return kept.withColumn(own, _mark()).dropDuplicates(["doc_id", own]).drop(own)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents stays (operator 2)."""
    bound_batches(spark)
    return _only(docs, component_heads(docs, _mark()), "id")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of their leaves take (operator 10)."""
    rows = mixing.with_tree(docs, keep={"mark": _mark()})
    chosen = mixing.select_mix(rows, budget_percent=MIX_PERCENT, epochs=1, mark="mark")
    return _only(docs, chosen, "id")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and their number, with its other columns (operator 4)."""
    bound_batches(spark)
    names = tuple(name for name in docs.columns if name.lower() not in ("text", "ids", "n_tokens"))
    return byte_bpe.encode(docs, keep=names)
