"""Paged layers: one landed row per response page.

A page body is parsed once into a VARIANT, which keeps the type each provider sent: a quoted
``"true"`` is no flag and a quoted ``"429"`` is no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed
from embergrid.functions.numbers import finite_number
from embergrid.functions.once import with_once
from embergrid.functions.text import body_preview, first_text
from embergrid.schemas import LANDED_PAGE

NUMBER_KIND = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def read_landed_pages(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Landed response pages: ``layer, result_offset, http_status, body``."""
    return spark.read.schema(LANDED_PAGE).format(file_format).load(path)


def _part(path: str, kind: str = "variant") -> Column:
    """A part of the page document; the body sits in a one-item array, see ``_documents``."""
    return F.try_variant_get("doc", f"$[0]{path}", kind)


def _kind(value: Column | str) -> Column:
    return F.schema_of_variant(value)


def _documents(pages: DataFrame) -> DataFrame:
    """Adds ``doc`` and ``is_json``; the body is parsed once.

    The JSON reader stops after the first value, so the body is put in brackets with a mark of its
    own behind it. Only a body that is one whole document leaves the mark as the second item: one
    that closes the brackets itself ends the value before the mark, and one with more items moves it.
    """
    mark = F.xxhash64("body").cast("string")
    wrapped = F.concat(F.lit("["), F.col("body"), F.lit(',"'), mark, F.lit('"]'))
    second = F.try_variant_get("doc", "$[1]", "string")
    third = F.try_variant_get("doc", "$[2]", "variant")
    return with_once(
        with_once(pages, doc=F.try_parse_json(wrapped)),
        is_json=F.col("doc").isNotNull() & F.coalesce(second == mark, F.lit(False)) & third.isNull(),
    )


def _errors(documents: DataFrame) -> DataFrame:
    """Adds ``has_error`` and the error's code and message.

    An error part that is not null, false, zero or empty counts. ``code_kind`` is NULL without a
    code.
    """
    parts = with_once(
        documents,
        error_kind=_kind(_part(".error")),
        error_text=_part(".error", "string"),
        code_kind=F.nullif(_kind(_part(".error.code")), F.lit("VOID")),
        error_code=finite_number(_part(".error.code", "string")),
        error_message=_part(".error.message", "string"),
    )
    kind, text = F.col("error_kind"), F.col("error_text")
    absent = (
        (kind == "VOID")
        | ((kind == "BOOLEAN") & (text == "false"))
        | ((kind == "STRING") & (text == ""))
        | (kind.rlike(NUMBER_KIND) & (finite_number(text) == 0))
    )
    has_error = F.col("is_json") & kind.isNotNull() & ~F.coalesce(absent, F.lit(False))
    return parts.withColumn("has_error", has_error).drop("error_kind", "error_text")


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Triage of every page.

    ``outcome`` is ``ok``, ``service_error``, ``invalid_json`` or ``no_response``. A service error
    is one the body reports, under any HTTP status, or a status outside 200-299. ``retryable`` is
    NULL for good pages.
    """
    status, outcome = F.col("http_status"), F.col("outcome")
    status_text = status.cast("string")
    failing = (status == 429) | (status >= 500)
    # A code counts by value from 500 up, but 429 only when sent as a number.
    code, code_kind = F.col("error_code"), F.col("code_kind")
    code_failing = (code >= 500) | ((code == 429) & code_kind.rlike(NUMBER_KIND))
    triaged = with_once(
        _errors(_documents(pages)),
        outcome=F.when(status.isNull(), "no_response")
        .when(~F.coalesce("is_json", F.lit(False)), "invalid_json")
        .when(F.col("has_error") | ~status.between(200, 299), "service_error")
        .otherwise("ok"),
        preview=F.when(
            status.isNotNull() & ~F.coalesce("is_json", F.lit(False)), body_preview(F.col("body"))
        ),
    )
    return (
        triaged.withColumn(
            "retryable",
            F.when(
                outcome == "service_error",
                F.coalesce(
                    F.when(code_kind.isNotNull(), code_failing).otherwise(failing), F.lit(False)
                ),
            )
            .when(outcome == "invalid_json", status.isin(400, 408) | failing)
            .when(outcome == "no_response", True),
        )
        .withColumn(
            "message",
            F.when(
                outcome == "service_error",
                first_text(
                    F.col("error_message"),
                    F.concat(F.lit(fixed.QUERY_ERROR_PREFIX), status_text),
                ),
            ).when(
                outcome == "invalid_json",
                F.concat(
                    F.lit(fixed.INVALID_JSON_PREFIX),
                    status_text,
                    F.lit(")"),
                    F.coalesce(F.concat(F.lit(": "), F.col("preview")), F.lit("")),
                ),
            ),
        )
        .drop("has_error", "is_json", "code_kind", "error_message")
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """Good pages with their length and transfer-limit flag."""
    return _measured(page_outcomes(pages).where(F.col("outcome") == "ok"))


def page_measures(pages: DataFrame) -> DataFrame:
    """All pages with outcome, length and flag; the latter two say nothing about a page that is not ``ok``."""
    return _measured(page_outcomes(pages))


def _measured(outcomes: DataFrame) -> DataFrame:
    """Adds ``items``, ``page_len`` and ``exceeded``.

    The flag is the root one, or the one under ``properties`` when the root one is missing or
    null; only a true boolean counts.
    """
    root = _part(".exceededTransferLimit")
    nested = _part(".properties.exceededTransferLimit")
    parts = with_once(
        outcomes,
        flag=F.when(root.isNull() | (_kind(root) == "VOID"), nested).otherwise(root),
        items=_part(".features", "array<variant>"),
    )
    is_set = (_kind("flag") == "BOOLEAN") & F.try_variant_get("flag", "$", "boolean")
    length = F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))
    return (
        parts.withColumn("page_len", length.cast("bigint"))
        .withColumn("exceeded", F.coalesce(is_set, F.lit(False)))
        .drop("flag")
    )


def page_features(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per feature of every good page, ordered by ``(result_offset, pos)``.

    A page whose ``features`` is missing or no array gives no rows. ``geometry`` and
    ``properties`` stay VARIANT.
    """
    return (
        page_facts(pages)
        .select("layer", "result_offset", *keep, F.posexplode("items").alias("pos", "item"))
        .select(
            "layer",
            "result_offset",
            *keep,
            "pos",
            F.try_variant_get("item", "$.id", "string").alias("feature_id"),
            F.try_variant_get("item", "$.geometry.type", "string").alias("geom_type"),
            F.try_variant_get("item", "$.geometry", "variant").alias("geometry"),
            F.try_variant_get("item", "$.properties", "variant").alias("properties"),
        )
    )


def refetch_list(pages: DataFrame) -> DataFrame:
    """Pages worth asking for again."""
    return (
        page_outcomes(pages)
        .where(F.col("retryable"))
        .select("layer", "result_offset", "http_status", "outcome", "message")
    )


def property_text(name: str) -> Column:
    """One provider property as text, NULL when missing or null."""
    return F.try_variant_get("properties", f"$.{name}", "string")
