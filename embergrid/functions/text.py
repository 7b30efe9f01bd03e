"""Text rules: fallbacks that skip empties, joined parts, state codes, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embergrid import fixed_values as fixed

# Fixed value: the white space that is trimmed and collapsed in previews.
SPACE = r"[\s\p{Zs}\x{2028}\x{2029}\x{FEFF}]"


def non_empty(text: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(text, F.lit(""))


def first_text(*texts: Column) -> Column:
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[non_empty(text) for text in texts])


def joined_text(*parts: Column, separator: str = ", ") -> Column:
    """Non-empty parts joined; NULL when nothing is left."""
    return non_empty(F.concat_ws(separator, *[non_empty(part) for part in parts]))


def class_id(prefix: str, size: Column) -> Column:
    """Id of a class: prefix and size."""
    return F.concat_ws("-", F.lit(prefix), size.cast("string"))


def state_code(state: Column) -> Column:
    """State without the leading country part; empty is NULL."""
    return F.regexp_replace(non_empty(state), "^US-", "")


def body_preview(body: Column) -> Column:
    """Trimmed, white space collapsed, first characters only; empty is NULL."""
    collapsed = F.regexp_replace(body, f"{SPACE}+", " ")
    return non_empty(F.substring(F.trim(collapsed), 1, fixed.PREVIEW_LENGTH))
