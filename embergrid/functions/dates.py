"""Date text from epoch milliseconds or from a date string, in UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output form, largest time value in ms, names of the months.
DATE_FORM = "MMM d, y"
MAX_TIME_MS = 8_640_000_000_000_000
DAY_MS = 86_400_000
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# One grammar for all accepted texts: a weekday, a day in one of six orders, a clock, a zone, a comment.
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_DAYS = (
    r"(?<y1>\d{4})(?:-(?<m1>\d{1,2})(?:-(?<d1>\d{1,2}))?)?",
    r"(?<y2>\d{4})/(?<m2>\d{1,2})/(?<d2>\d{1,2})",
    r"(?<m3>\d{1,2})/(?<d3>\d{1,2})/(?<y3>\d{4})",
    r"(?<m4>[a-z]{3,9})\.?[\s-]+(?<d4>\d{1,2})(?:\s*,\s*|[\s-]+)(?<y4>\d{4})",
    r"(?<d5>\d{1,2})[\s-]+(?<m5>[a-z]{3,9})\.?(?:\s*,\s*|[\s-]+)(?<y5>\d{4})",
)
_CLOCK = r"(?:(?:t|,?\s+)(?<hour>\d{1,2}):(?<minute>\d{2})(?::\d{2}(?:\.\d+)?)?\s*(?<half>[ap]m)?"
_ZONE = r"\s*(?<zone>z|gmt|utc)?\s*(?<offset>[+-]\d{2}:?\d{2})?)?(?:\s+(?:gmt|utc|z))?(?:\s*\([^()]*\))?"
GRAMMAR = rf"(?is)^\s*{_WEEKDAY}(?:{'|'.join(_DAYS)}){_CLOCK}{_ZONE}\s*$"
# What a text matches, as fields behind one another.
_FIELDS = "|".join(
    ["=", *("".join(f"${{{field}{place}}}" for place in range(1, len(_DAYS) + 1)) for field in "ymd")]
    + ["${hour}", "${minute}", "${half}", "${offset}"]
)


def date_from_ms(ms: Column) -> Column:
    """UTC day of an epoch-millisecond value; values out of range are NULL."""
    day = ((ms - F.pmod(ms, F.lit(DAY_MS))) / DAY_MS).cast("int")
    return F.when(F.abs(ms) <= MAX_TIME_MS, F.date_from_unix_date(day))


def date_from_text(text: Column) -> Column:
    """UTC day of a date string; bare digits other than a year are NULL, and so are days that are none.

    The text is cut into fields in one pass. Months go by number or by their first three letters. A
    clock with an offset is moved to UTC; text without one is read and printed in the same zone, so
    the session zone drops out. A clock needs a whole day before it.
    """
    fields = F.split(F.regexp_replace(text, GRAMMAR, _FIELDS), r"\|", -1)
    return _bound(fields, _day, text.rlike(r"\d") & ~text.contains("|"))


def _bound(value: Column, use: Callable[[Column], Column], where: Column | None = None) -> Column:
    """``use`` of a value that is computed once, however often it is read: the item of an array."""
    item = F.array(value)
    return F.get(F.transform(item if where is None else F.when(where, item), use), 0)


def _day(fields: Column) -> Column:
    def field(index: int) -> Column:
        return F.nullif(F.get(fields, F.lit(index)), F.lit(""))

    def number(index: int) -> Column:
        return field(index).try_cast("int")

    name = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(field(2), 1, 3))).cast("int")
    month = F.when(field(2).isNull(), 1).otherwise(F.coalesce(number(2), name))
    noon = F.when(F.lower(field(6)) == "pm", 12).otherwise(0)
    hour = _bound(
        number(4),
        lambda shown: F.when(field(6).isNull(), shown).when(shown.between(1, 12), shown % 12 + noon),
    )
    offset = _bound(
        F.regexp_replace(field(7), ":", ""),
        lambda zone: (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))
        * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1),
    )
    numbers = F.struct(
        number(1).alias("year"),
        month.alias("month"),
        F.when(field(3).isNull(), 1).otherwise(number(3)).alias("day"),
        (hour * 60 + number(5)).alias("minutes"),
        (number(5) < 60).alias("clock"),
        field(3).isNotNull().alias("has_day"),
        offset.alias("ahead"),
    )
    return _bound(numbers, _calendar_day, (F.get(fields, F.lit(0)) == "=") & (F.size(fields) == 8))


def _calendar_day(at: Column) -> Column:
    clock_fits = at["clock"].isNull() | (at["clock"] & at["has_day"] & (at["minutes"] <= 1440))
    moved = F.when(at["ahead"].isNotNull(), F.floor((at["minutes"] - at["ahead"]) / 1440).cast("int")).otherwise(0)

    def in_month(first: Column) -> Column:
        # A day past the end of its month is in no month.
        whole = clock_fits & (at["day"] >= 1) & (at["day"] <= F.dayofmonth(F.last_day(first)))
        return F.when(whole, F.date_add(first, at["day"] - 1 + moved))

    return _bound(F.make_date(at["year"], at["month"], F.lit(1)), in_month, at["month"].between(1, 12) & (at["year"] > 0))


def date_text(ms: Column | None = None, text: Column | None = None) -> Column:
    """Short date such as ``Nov 14, 2023``; NULL when neither input is a date."""
    days = []
    if ms is not None:
        days.append(date_from_ms(ms))
    if text is not None:
        days.append(date_from_text(text))
    return F.date_format(F.coalesce(*days), DATE_FORM)
