"""Text primitives with the inventory's own rules: trimming drops every byte up to 0x20,
case folds in ASCII only, lengths count bytes, and the empty string means missing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Joins fields of a key; no field can hold it.
SEPARATOR = "\x01"


def present(c: Column | str) -> Column:
    """The column as text, with null as the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def key_part(c: Column) -> Column:
    """Length-prefixed, so that joined parts stay unambiguous."""
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def excerpt(c: Column, limit: int = 120) -> Column:
    """A short form for messages: controls become '?', long texts end in '...'."""
    shown = F.regexp_replace(c, r"[\x00-\x1F\x7F]", "?")
    return F.when(F.length(shown) > limit, F.concat(F.substring(shown, 1, limit - 3), F.lit("..."))).otherwise(shown)


def contains_text(haystack: Column, needle: str) -> Column:
    """Substring search without regard to ASCII case; an empty needle matches."""
    return F.lit(True) if not needle else lower(haystack).contains(needle.translate(str.maketrans(UPPER, LOWER)))


def base_name(path: Column) -> Column:
    """The last segment of a path with either separator, without trailing ones."""
    return F.regexp_extract(F.regexp_replace(F.translate(trim(path), "\\", "/"), r"/+$", ""), r"([^/]*)$", 1)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading './' or '/', no trailing '/'."""
    slashed = F.translate(path, "\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(slashed, r"^(\./)+", ""), "^/+", ""), "/+$", "")


def tokens(c: Column) -> Column:
    """The trimmed, non-empty parts of a comma-delimited list."""
    return F.filter(F.transform(F.split(c, ","), trim), lambda t: t != "")


def has_token(c: Column, token: str) -> Column:
    """Whether tokens(c) hold the token, without regard to ASCII case."""
    return c.rlike(rf"(?i)(?:^|,)[\x00-\x20]*{re.escape(token)}[\x00-\x20]*(?:,|\z)")


def distinct_folded(values: Column) -> Column:
    """Values of an array that differ beyond ASCII case, ordered by (folded, bytes); of
    those that differ by case alone the first in the array stays."""
    indexed = F.transform(values, lambda v, i: F.struct(lower(v).alias("k"), i.alias("i"), v.alias("v")))
    ordered = F.array_sort(indexed)
    kept = F.filter(
        F.transform(ordered, lambda e, i: F.struct(e["v"].alias("v"), ((i == 0) | (F.get(ordered, i - 1)["k"] != e["k"])).alias("f"))),
        lambda e: e["f"],
    )
    return F.transform(kept, lambda e: e["v"])


def join_values(values: Column) -> Column:
    return F.array_join(values, "; ")
