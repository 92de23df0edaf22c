"""Expressions over prompt texts, references and request paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: characters per token in the size heuristics.
CHARS_PER_TOKEN = 4

_SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
_QUERY_OR_FRAGMENT = r"[?#].*$"
_ID_SEGMENT = (
    r"/(?:[0-9]+|[0-9a-fA-F]{32}|"
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})(?=/|$)"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def stripped_shorter_than(text: Column, count: int) -> Column:
    """``char_length(strip(text)) < count`` without stripping most texts.

    Two characters that are no white space and lie ``count`` places apart settle it, and are
    mostly found near the start. Only a text without such a pair there is stripped as a whole.
    """
    if count <= 0:
        return F.lit(False)
    solid = "[^" + "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE) + "]"
    pair = solid if count == 1 else f"(?s){solid}.{{{count - 2}}}{solid}"
    settled = F.substring(text, 1, max(64, 2 * count)).rlike(pair)
    return F.when(settled, F.lit(False)).otherwise(F.char_length(strip(text)) < count)


def whole_quotient(value: Column, divisor: int) -> Column:
    return F.call_function("div", value, F.lit(divisor))


def prompt_size(text: Column) -> Column:
    """Size used by the length rule: code points / 4, rounded down."""
    return whole_quotient(F.char_length(F.coalesce(text, F.lit(""))), CHARS_PER_TOKEN)


def estimated_tokens(text: Column) -> Column:
    """Size used for cost: as ``prompt_size``, but at least 1 for a non-empty text."""
    size = prompt_size(text)
    return F.when(F.char_length(F.coalesce(text, F.lit(""))) == 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), size)
    )


def last_segment(reference: Column) -> Column:
    """Chunk key of a result reference: what follows the last slash."""
    return F.substring_index(reference, "/", -1)


def preview(text: Column, length: int = 100) -> Column:
    """One-line preview: line feeds become blanks, long texts end in three dots."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def route_template(url_or_path: Column) -> Column:
    """Path without host, query and ids, so that it has few distinct values."""
    path = F.regexp_replace(F.regexp_replace(url_or_path, _SCHEME_AND_HOST, ""), _QUERY_OR_FRAGMENT, "")
    return F.regexp_replace(path, _ID_SEGMENT, "/{id}")
