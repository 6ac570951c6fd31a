"""Directional comparison of two component snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import row_key, weak_identity
from ..functions.purl import strong_identity
from ..functions.text import excerpt, key_part, present, trim
from ..schemas import CHANGE_KINDS
from ..shared import saved

FIELDS = ["name", "version", "ecosystem", "component_type", "package_url", "scope", "source_artifact", "source_parser", "sha256"]


def snapshots(components: DataFrame, side: str = "side") -> DataFrame:
    """Comparable rows: trimmed fields, strong and weak identity, tie key."""
    rows = components.select(
        F.col(side).alias("side"),
        *[trim(present(c)).alias(c) for c in FIELDS if c != "scope"],
        trim(present("dependency_scope")).alias("scope"),
    )
    rows = rows.withColumn("strong", strong_identity(F.col("package_url"))).withColumn("weak", weak_identity())
    tie = F.concat(
        F.when(F.col("strong") != "", "0").otherwise("1"),
        *[key_part(F.col(c)) for c in ("package_url", "name", "ecosystem", "component_type", "scope", "source_artifact", "source_parser", "sha256")],
    )
    return rows.withColumn("tie", tie)


def weak_index(rows: DataFrame) -> DataFrame:
    """Of each weak identity over both sides: its only strong identity, or null; whether
    it has several; whether some row has none. Two extremes tell one from several, so
    nothing is collected."""
    strong = F.nullif(F.col("strong"), F.lit(""))
    return (
        rows.groupBy("weak")
        .agg(F.min(strong).alias("low"), F.max(strong).alias("high"), F.bool_or(F.col("strong") == "").alias("missing"))
        .select(
            "weak",
            F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"),
            F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("several"),
            "missing",
        )
    )


def assigned(rows: DataFrame, index: DataFrame) -> DataFrame:
    """A row without a strong identity adopts its weak identity's only one."""
    own = F.nullif(F.col("strong"), F.lit(""))
    return rows.join(index.select("weak", "only"), "weak").withColumn("identity", F.coalesce(own, "only", "weak"))


def versions(rows: DataFrame) -> DataFrame:
    """One row per identity, side and version; of duplicates the one of least tie key."""
    return rows.groupBy("identity", "side", "version").agg(
        F.min_by(F.struct(*FIELDS), "tie").alias("item"), F.count(F.lit(1)).alias("n")
    )


def changes(found: DataFrame, before: str = "baseline", after: str = "current") -> DataFrame:
    """Change rows, and one row of kind 'unchanged' per version that both sides have.

    An identity with exactly one version on each side, and not the same, is one change of
    version; any other version of one side alone is removed or added. Partitioned by
    identity once, for the version pairs and the per-identity counts alike."""
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("item")))
    pairs = found.repartition("identity").groupBy("identity", "version").agg(of(before).alias("b"), of(after).alias("a"))
    own = W.partitionBy("identity")
    counted = pairs.withColumns(
        {
            "n_b": F.count("b").over(own),
            "n_a": F.count("a").over(own),
            "other": F.max("a").over(own),
        }
    )
    swapped = (F.col("n_b") == 1) & (F.col("n_a") == 1)
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    kind = (
        F.when(both, "unchanged")
        .when(swapped & F.col("b").isNotNull(), CHANGE_KINDS[2])
        .when(swapped, None)  # told by the row of the other side
        .when(F.col("b").isNotNull(), CHANGE_KINDS[1])
        .otherwise(CHANGE_KINDS[0])
    )
    rows = counted.withColumn("kind", kind).where("kind is not null")
    a = F.when(F.col("kind") == CHANGE_KINDS[2], F.col("other")).otherwise(F.col("a"))
    rows = rows.select("identity", "kind", "b", a.alias("a"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    later = lambda f: F.coalesce(F.nullif(F.col(f"a.{f}"), F.lit("")), F.col(f"b.{f}"), F.lit(""))
    ordinal = F.array_position(F.array(*[F.lit(k) for k in CHANGE_KINDS]), F.col("kind")) - 1
    return rows.select(
        "kind",
        row_key(ordinal, F.col("identity"), text("b.version"), text("a.version")).alias("row_key"),
        F.col("identity").alias("identity_key"),
        *[later(f).alias(f) for f in ("name", "ecosystem", "component_type")],
        text("b.version").alias("before_version"),
        text("a.version").alias("after_version"),
        text("b.package_url").alias("before_package_url"),
        text("a.package_url").alias("after_package_url"),
        text("b.scope").alias("before_scope"),
        text("a.scope").alias("after_scope"),
    )


def compare(components: DataFrame, side: str = "side") -> DataFrame:
    rows = saved(snapshots(components, side), "snapshots")  # for the index, and for the rows
    return changes(versions(assigned(rows, weak_index(rows)))).where("kind <> 'unchanged'")


def counters(components: DataFrame, side: str = "side") -> DataFrame:
    """One row: added, removed, unchanged, version_changed."""
    rows = saved(snapshots(components, side), "snapshots")  # for the index, and for the rows
    found = changes(versions(assigned(rows, weak_index(rows))))
    return found.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in (*CHANGE_KINDS, "unchanged")])


def warnings(components: DataFrame, side: str = "side") -> DataFrame:
    """kind and subject of what a reader of the comparison should know: an identity that
    fell back on fields, one that maps to several package URLs, duplicates of a version,
    and the number of identities that no package URL backs."""
    rows = saved(snapshots(components, side), "snapshots")  # for the index, and for the rows
    index = weak_index(rows)
    fell = index.where("missing and only is not null").select(F.lit("fallback").alias("kind"), excerpt(F.col("weak")).alias("subject"))
    several = index.where("missing and several").select(F.lit("ambiguous").alias("kind"), excerpt(F.col("weak")).alias("subject"))
    fields = index.where("missing and only is null and not several").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    fields = fields.select(F.lit("fields-only").alias("kind"), F.col("n").cast("string").alias("subject"))
    twice = versions(assigned(rows, index)).where("n > 1")
    twice = twice.select(
        F.concat(F.lit("duplicate-"), F.col("side")).alias("kind"),
        F.concat(excerpt(F.col("identity")), F.lit(" "), excerpt(F.col("version"))).alias("subject"),
    )
    return fell.unionByName(several).unionByName(fields).unionByName(twice).distinct()


def ordered(found: DataFrame) -> DataFrame:
    kind = F.array_position(F.array(*[F.lit(k) for k in CHANGE_KINDS]), F.col("kind"))
    return found.orderBy(kind, "identity_key", "before_version", "after_version", "ecosystem", "name", "component_type", "row_key")
