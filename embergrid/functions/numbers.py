"""Number parsing and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: decimal numbers with optional sign, fraction and exponent.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

INFINITY = float("inf")


def finite(number: Column) -> Column:
    """The double itself when finite, else NULL. NaN sorts above infinity, so one test is enough."""
    return F.when(F.abs(number) < F.lit(INFINITY), number)


def finite_number(text: Column) -> Column:
    """Text to a finite double, else NULL.

    The pattern keeps out what a Spark cast takes but a provider number is not
    (``1d``, ``inf``, ``NaN``); overflow to infinity is NULL too.
    """
    return F.when(text.rlike(NUMBER_PATTERN), finite(text.try_cast("double")))


def number_text(number: Column, digits: int) -> Column:
    """Grouped en-US text with at most ``digits`` decimals, ties away from zero."""
    pattern = "#,##0" + ("." + "#" * digits if digits else "")
    return F.call_function("format_number", F.round(finite(number), digits), F.lit(pattern))


def plain_text(number: Column) -> Column:
    """Shortest plain text of a double: ``90`` for 90.0, no exponent from 1e-6 up to 1e21."""
    text = number.cast("string")
    size = F.abs(number)
    decimal = F.when(size < 1, text.try_cast("decimal(38,30)").cast("string")).otherwise(
        text.try_cast("decimal(38,16)").cast("string")
    )
    short = F.replace(F.lower(text), F.lit(".0e"), F.lit("e"))
    exponent = F.regexp_replace(short, "e([0-9])", "e+$1")
    return (
        F.when(number == 0, "0")
        .when(~(size < F.lit(INFINITY)), None)
        .when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", ""))
        .when((size >= 1e-6) & (size < 1e21), F.regexp_replace(decimal, r"\.?0+$", ""))
        .otherwise(exponent)
    )
