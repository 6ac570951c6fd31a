"""Predicates on version texts. No version order exists: versions compare as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lower, trim

#: What marks a version text as a reference to a source, anywhere or at
#: the start; constraint characters; moving tags.
SOURCE_REFERENCE = r"://|git\+|file:|link:|workspace:|path:|^npm:|^github:|^gitlab:|^bitbucket:|^ssh:|^git:|^git@|[/\\#${}]"
CONSTRAINT = r"[<>=~^*|, \[\]()]|\+$|(^|[.\-])x($|[.\-])"
MOVING_TAG = r"^(latest|next|stable|latest\..*)$"
#: An npm version: numeric core of n segments, then an optional suffix.
NPM_CORE, NPM_SUFFIX = r"[0-9]+(\.[0-9]+)", r"([-+][A-Za-z0-9\-.+]+)"


def _at_end(pattern: str) -> str:
    """The pattern, whose ends are that of the text and not that before a last line feed."""
    return pattern.replace("$", r"\z")


def is_source_reference(version: Column) -> Column:
    return lower(trim(version)).rlike(f"(?s){SOURCE_REFERENCE}")


def is_range(version: Column) -> Column:
    v = lower(trim(version))
    return (v != "") & ~is_source_reference(version) & v.rlike(f"(?s){_at_end(CONSTRAINT)}")


def is_exact(version: Column) -> Column:
    """Neither a source reference, nor a range, nor a moving tag: told by one pattern, so that
    the version is trimmed and folded as seldom as that."""
    v = lower(trim(version))
    return (v != "") & ~v.rlike(f"(?s){SOURCE_REFERENCE}|{_at_end(CONSTRAINT)}|{_at_end(MOVING_TAG)}")


def _npm(version: Column, pattern: str) -> Column:
    return trim(version).rlike(rf"^[vV]?{pattern}\z")


def is_exact_in(ecosystem: Column, version: Column) -> Column:
    npm = lower(trim(ecosystem)) == "npm"
    return is_exact(version) & (~npm | _npm(version, NPM_CORE + "{2}" + NPM_SUFFIX + "?"))


def is_range_in(ecosystem: Column, version: Column) -> Column:
    npm = lower(trim(ecosystem)) == "npm"
    return is_range(version) | (npm & is_exact(version) & _npm(version, NPM_CORE + "{0,1}"))


def is_exact_binary(version: Column) -> Column:
    """Two to eight dotted numbers, one of them not zero."""
    return version.rlike(r"^[0-9]+(\.[0-9]+){1,7}\z") & version.rlike("[1-9]")


def is_numeric_dotted(version: Column) -> Column:
    return version.rlike(r"^[0-9]+(\.[0-9]+)*\z")


def native_library_version(name: Column) -> Column:
    """The version in a library's file name: after .so. if it has a dot, or before .dylib.
    Names of DLLs carry none."""
    so = F.regexp_extract(name, r"(?i)\.so\.([0-9]+(?:\.[0-9]+)+)\z", 1)
    dylib = F.regexp_extract(name, r"(?i)[^.]\.([0-9]+(?:\.[0-9]+)*)\.dylib\z", 1)
    return F.when(so != "", so).otherwise(dylib)


def soname_abi(ecosystem: Column, name: Column) -> Column:
    """The bare number after the first .so. of a native library's name."""
    native = lower(trim(ecosystem)) == "native"
    base = F.regexp_extract(F.translate(trim(name), "\\", "/"), r"([^/]*)$", 1)
    return F.when(native, F.regexp_extract(base, r"^(?:(?!\.[sS][oO]\.).)*\.[sS][oO]\.([0-9]+)\z", 1)).otherwise("")
