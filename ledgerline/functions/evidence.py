"""What binaries, archives and stored scans allow to be concluded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .purl import maven_url
from .text import lower, present, trim
from .versions import is_exact_binary

MAX_COORDINATE_BYTES = 512


def _cpe_part(c: Column) -> Column:
    """Words joined by underscores; null where a character fits no word or separator."""
    value = lower(trim(present(c)))
    words = F.regexp_replace(F.regexp_replace(value, r"[ \t.,\-_/\\()\[\]{}+&]+", "_"), "^_+|_+$", "")
    return F.when(value.rlike(r"^[a-z0-9 \t.,\-_/\\()\[\]{}+&]+\z") & (words != ""), words)


def evidence_cpe(company: Column, product: Column, version: Column) -> Column:
    """A platform name from a binary's company and product; empty without both."""
    exact = F.when(is_exact_binary(trim(present(version))), trim(present(version))).otherwise("*")
    made = F.concat(F.lit("cpe:2.3:a:"), _cpe_part(company), F.lit(":"), _cpe_part(product), F.lit(":"), exact, F.lit(":*:*:*:*:*:*:*"))
    return F.coalesce(made, F.lit(""))


def is_literal_coordinate(c: Column, version: bool = False) -> Column:
    """Whether a coordinate is a plain value, without variables or separators."""
    value = trim(present(c))
    bad = r"[\\ ]" if version else r"[/\\:= \t]"
    sized = (value != "") & (F.octet_length(value) <= MAX_COORDINATE_BYTES)
    return sized & ~value.rlike(r"\$\{|#\{|@|[\x00-\x1F\x7F]") & ~value.rlike(bad)


def archive_url(group: Column, artifact: Column, version: Column) -> Column:
    literal = is_literal_coordinate(group) & is_literal_coordinate(artifact) & is_literal_coordinate(version, True)
    return F.when(literal, maven_url(trim(group), trim(artifact), trim(version))).otherwise("")


def is_within(path: Column, root: Column) -> Column:
    bare = F.regexp_replace(root, "/+$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def same_target(directory: Column, other: Column, name: Column, other_name: Column) -> Column:
    """Equal folders; where neither scan has one, equal root names."""
    a, b = (F.regexp_replace(trim(present(c)), "/+$", "") for c in (directory, other))
    return F.when((a == "") & (b == ""), trim(present(name)) == trim(present(other_name))).otherwise((a != "") & (a == b))


def is_task_id(c: Column) -> Column:
    return present(c).rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def export_name(created: Column, root: Column, task: Column) -> Column:
    """The file name of an exported document: digits of the time, a safe root, the id."""
    digits = F.regexp_replace(F.substring(present(created), 1, 19), "[^0-9]", "")
    stamp = F.concat(F.substring(digits, 1, 8), F.lit("_"), F.substring(digits, 9, 6))
    safe = F.coalesce(F.nullif(F.regexp_replace(trim(present(root)), r"[^A-Za-z0-9._\-]+", "_"), F.lit("")), F.lit("project"))
    return F.concat_ws("_", stamp, safe, F.concat(present(task), F.lit(".cdx.json")))
