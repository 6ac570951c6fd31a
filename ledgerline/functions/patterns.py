"""Ignore patterns: '*' and '?' wildcards over whole paths or single segments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_path

#: What scans ignore by default.
DEFAULT_IGNORED = (".git", ".svn", ".hg", ".idea", ".vscode", ".cache", "__pycache__", "node_modules", ".venv", "venv")


def wildcard_regex(pattern: str) -> str:
    """The anchored regular expression of a wildcard pattern; '*' crosses slashes."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + r"\z"


def _segment_test(pattern: str) -> Callable[[Column], Column]:
    regex = wildcard_regex(pattern)
    return lambda segment: segment.rlike(regex)


def ignores(path: Column, is_directory: Column | bool, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether any pattern ignores the path. Blank patterns and comments are skipped;
    a pattern without a slash is tested on each segment, one with a slash on the whole
    path, and for directories on the path with a trailing slash too."""
    path = normalize_path(path)
    is_directory = F.lit(is_directory) if isinstance(is_directory, bool) else is_directory
    out = F.lit(False)
    for raw in patterns:
        pattern = raw.strip()
        if not pattern or pattern.startswith("#"):
            continue
        pattern = re.sub("/+$", "", re.sub("^/+", "", re.sub(r"^(\./)+", "", pattern.replace("\\", "/"))))
        if not pattern:
            continue
        if "/" not in pattern:
            out = out | F.exists(F.split(path, "/"), _segment_test(pattern))
        else:
            out = out | path.rlike(wildcard_regex(pattern))
            out = out | (is_directory & F.concat(path, F.lit("/")).rlike(wildcard_regex(pattern + "/*")))
    return out
