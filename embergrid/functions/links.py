"""Links: https only, escaped ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: marks that form encoding escapes and a URL component keeps.
KEPT_MARKS = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def https_url(url: Column) -> Column:
    """The URL as given when it is a valid https one, else NULL.

    Only scheme and authority decide validity, so a path with blanks or brackets still counts.
    """
    authority = F.regexp_extract(url, r"(?i)^\s*https:[/\\]*([^/\\?#]+)", 1)
    probe = F.try_parse_url(F.concat(F.lit("https://"), authority, F.lit("/")), F.lit("PROTOCOL"))
    return F.when((authority != "") & probe.isNotNull(), url)


def url_component(text: Column) -> Column:
    """Percent-encoding for one URL component."""
    encoded = F.url_encode(text)
    for escaped, plain in KEPT_MARKS:
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return encoded


def id_link(prefix: str, identifier: Column) -> Column:
    """Prefix and escaped id; no link for a NULL, empty or zero id."""
    text = identifier.cast("string")
    return F.when(~text.isin("", "0"), F.concat(F.lit(prefix), url_component(text)))
