"""Reuse of evidence between scans, keyed by what a file is and by how it is scanned."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

KEY = ["relative_path", "identity", "content_sha256"]


def context_hash(root: str, root_identity: str, patterns: list[str], **flags: bool) -> str:
    """Of everything besides the files that decides a scan's result; parts carry their
    length, and patterns are a set."""
    parts = ["evidence-1", root, root_identity, *[f"{k}={v}" for k, v in sorted(flags.items())], *sorted(set(patterns))]
    return hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()


def split(files: DataFrame, snapshot: DataFrame, context: str, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits with their evidence, misses). Files carry a fresh digest of their content;
    refresh makes every file a miss."""
    entries = snapshot.where((F.col("context") == context) & F.lit(not refresh)).select(*KEY, "evidence")
    return files.join(entries, KEY), files.join(entries, KEY, "left_anti")


def commit(spark: SparkSession, entries: DataFrame, folder: str, context: str) -> int:
    """Commits the entries of a scan as a new version of the snapshot. Entries with a
    missing key, or a key twice, poison it: nothing is committed (ValueError). Entries of
    other contexts stay; of this context only those of this scan do. Another scan's commit
    meanwhile is built upon, never lost."""
    bad = entries.where(" or ".join(f"{k} is null or {k} = ''" for k in KEY)).limit(1).count()
    if bad:
        raise ValueError("an entry has no key")
    if not entries.groupBy(*KEY).count().where("count > 1").isEmpty():
        raise ValueError("a key occurs twice")
    own = entries.select(*KEY, "evidence").withColumn("context", F.lit(context))

    def joined(rows: DataFrame | None) -> DataFrame:
        return own if rows is None else rows.where(F.col("context") != context).select(own.columns).unionByName(own)

    return store.update(spark, folder, joined)


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest sound snapshot, or None."""
    return store.load(spark, folder)[0]
