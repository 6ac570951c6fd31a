"""Matching components with a table of known issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.purl import with_lookup
from ..functions.text import present

#: Fixed value: candidates of one request.
BATCH = 128


def candidates(rows: DataFrame, purl: str = "package_url") -> DataFrame:
    """Adds reason ('' if eligible) and canonical."""
    return with_lookup(rows, present(purl))


def distinct_candidates(rows: DataFrame, purl: str = "package_url") -> DataFrame:
    """purl, how many rows have it, reason and canonical: one row per package URL, so that
    each is judged once."""
    return candidates(rows.groupBy(present(purl).alias("purl")).agg(F.count(F.lit(1)).alias("n")), "purl")


def candidate_counts(rows: DataFrame, purl: str = "package_url") -> DataFrame:
    """One row: eligible (distinct), duplicates, rejected. Counts per canonical form come
    first, so that the total needs one row per form."""
    per = distinct_candidates(rows, purl).groupBy("canonical").agg(F.sum("n").alias("n"))
    ok = F.col("canonical") != ""
    return per.agg(
        F.count_if(ok).alias("eligible"),
        F.coalesce(F.sum(F.when(ok, F.col("n") - 1)), F.lit(0)).cast("long").alias("duplicates"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).cast("long").alias("rejected"),
    )


def rejections(rows: DataFrame, purl: str = "package_url") -> DataFrame:
    return distinct_candidates(rows, purl).where("reason <> ''").groupBy("reason").agg(F.sum("n").alias("n"))


def batches(rows: DataFrame, purl: str = "package_url") -> DataFrame:
    """canonical and its batch: distinct eligible candidates in batches of at most BATCH.
    Batches follow a hash of the candidate, numbered inside each hash bucket, so that no
    task numbers them all."""
    distinct = distinct_candidates(rows, purl).where("reason = ''").select("canonical").distinct()
    bucket = F.pmod(F.xxhash64("canonical"), F.lit(256))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("canonical")) - 1
    return distinct.withColumn("bucket", bucket).select("canonical", "bucket", F.floor(rank / BATCH).cast("int").alias("batch"))


def matches(rows: DataFrame, advisories: DataFrame, purl: str = "package_url", judged: DataFrame | None = None) -> DataFrame:
    """package_url (canonical), advisory_id, and the latest modified of the pair. judged:
    the rows' distinct_candidates, where they are at hand. Which side is broadcast, if one
    is small enough, is left to Spark's size check."""
    judged = distinct_candidates(rows, purl) if judged is None else judged
    wanted = judged.where("reason = ''").select(F.col("canonical").alias("package_url")).distinct()
    known = advisories.groupBy("package_url", "advisory_id").agg(F.max("modified").alias("modified"))
    return known.join(wanted, "package_url")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("package_url").agg(F.count(F.lit(1)).alias("issues"))
