"""Texts for lists and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lower, present, trim


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two ISO-8601 texts, whichever is first; 0 where one fails."""
    a, b = (F.try_to_timestamp(present(c)) for c in (start, end))
    return F.coalesce(F.abs(F.unix_millis(b) - F.unix_millis(a)), F.lit(0)).cast("long")


def duration_text(ms: Column) -> Column:
    ms = F.greatest(ms, F.lit(0))
    tenths = lambda x: F.format_string("%.1f", F.round(x / 1000.0, 1))
    return F.when(ms < 60000, F.concat(tenths(ms), F.lit(" s"))).otherwise(
        F.concat(F.floor(ms / 60000).cast("string"), F.lit(" min "), tenths(ms % 60000), F.lit(" s"))
    )


def size_text(n: Column) -> Column:
    """Steps of 1024 with one decimal, up to TiB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        scaled = F.concat(F.format_string("%.1f", F.round(n / float(1024**k), 1)), F.lit(f" {unit}"))
        out = F.when(F.abs(n) >= 1024**k, scaled).otherwise(out)
    return out


#: Marks before a status.
GOOD, CAREFUL, BAD, NEUTRAL = "\u2713", "\u26a0", "\u2715", "\u2022"


def status_text(status: Column) -> Column:
    """An artifact's status as lists show it."""
    value = trim(present(status))
    folded = lower(value)
    return (
        F.when(value == "", "")
        .when(folded == "parsed", F.concat(F.lit(f"{GOOD} "), value))
        .when(folded == "failed", F.concat(F.lit(f"{BAD} "), value))
        .when(folded == "partially parsed", f"{CAREFUL} partial")
        .when(folded == "detected but unsupported", f"{CAREFUL} unsupported")
        .otherwise(F.concat(F.lit(f"{CAREFUL} "), value))
    )


def change_text(kind: Column) -> Column:
    """A change's kind as lists show it."""
    folded = lower(present(kind))
    return F.when(folded == "added", "+ Added").when(folded == "removed", "- Removed").when(folded == "version_changed", "~ Changed").otherwise("Changed")


def needs_review(status: Column, warnings: Column, errors: Column, files: Column, matches: Column) -> Column:
    return (status == "completed") & ((warnings > 0) | (errors > 0) | (files == 0) | (matches > 0))


def task_text(status: Column, review: Column) -> Column:
    return (
        F.when(review, f"{CAREFUL} completed with warnings")
        .when(status == "completed", F.concat(F.lit(f"{GOOD} "), status))
        .when(status == "failed", F.concat(F.lit(f"{BAD} "), status))
        .when(status == "cancelled", F.concat(F.lit(f"{CAREFUL} "), status))
        .otherwise(F.concat(F.lit(f"{NEUTRAL} "), status))
    )


def task_status(text: Column) -> Column:
    folded = lower(present(text))
    return F.when(folded.isin("running", "completed", "cancelled", "failed"), folded).otherwise("pending")


def artifact_status(text: Column) -> Column:
    folded = lower(present(text))
    return F.when(folded.isin("parsed", "partially parsed", "failed"), folded).otherwise("detected but unsupported")


def issue_text(requested: Column, complete: Column, eligible: Column, n: Column) -> Column:
    """The known-issue cell of a component."""
    return (
        F.when(~requested, "")
        .when(n > 0, F.concat(F.lit(f"{CAREFUL} "), n.cast("string")))
        .when(~eligible, "Not queried")
        .when(complete, "0 observed")
        .otherwise("Incomplete")
    )
