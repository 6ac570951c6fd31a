"""python -m ledgerline --scan FOLDER --output FILE [--settings FILE] [--cache FOLDER] [--refresh]

Scans a folder and writes its inventory document. Exit code 0: written; 1: the scan or
the writing failed; 2: wrong arguments or settings.
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from dataclasses import replace
from datetime import UTC, datetime

from . import __doc__ as about
from .settings import Settings, load

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerline", description=about)
    out.add_argument("--scan", required=True, metavar="FOLDER")
    out.add_argument("--output", required=True, metavar="FILE")
    out.add_argument("--settings", metavar="FILE")
    out.add_argument("--cache", metavar="FOLDER", help="keep evidence there and reuse that of unchanged files; needed with use_rescan_cache")
    out.add_argument("--refresh", action="store_true", help="parse every file and keep its evidence anew")
    out.add_argument("--version", action="version", version=VERSION)
    return out


def write(path: str, text: str) -> None:
    """The whole file or nothing: it gets its name when it is complete."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def main(arguments: list[str] | None = None, spark=None) -> int:
    given = parser().parse_args(arguments)
    try:
        settings = load(given.settings) if given.settings else Settings()
    except (OSError, ValueError) as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    if (settings.use_rescan_cache or given.refresh) and not given.cache:
        print("name the cache's folder: --cache FOLDER", file=sys.stderr)
        return 2
    if given.refresh:
        settings = replace(settings, refresh_rescan_cache=True)
    root = os.path.realpath(given.scan)
    if not os.path.isdir(root):
        print(f"no folder: {given.scan}", file=sys.stderr)
        return 2
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import document
    from .scan import scan
    from .shared import folder

    spark = spark or SparkSession.builder.appName("ledgerline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    try:
        found = scan(spark, root, settings, given.cache)
        task = document.Task(
            str(uuid.uuid4()), now, root, os.path.basename(root), settings.sbom_author_organization, settings.sbom_author_email,
            settings.include_absolute_paths, VERSION, found.artifacts.count(),
        )
        try:
            write(given.output, document.render(document.document_rows(task, found.components, found.artifacts)))
        except document.TooLarge:
            lines = document.document_lines(task, found.components, found.artifacts)
            document.assemble(document.write_lines(lines, f"{folder(spark)}/document-{uuid.uuid4().hex}"), given.output)
    except (OSError, ValueError, PySparkException) as e:
        print(f"scan: {e}", file=sys.stderr)
        return 1
    for r in found.warnings.orderBy("relative_path").toLocalIterator():
        print(f"{r['relative_path']}: {r['message']}", file=sys.stderr)
    for r in found.artifacts.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status").collect():
        print(f"{r['status']}: {r['n']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
