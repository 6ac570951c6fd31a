"""The dependency graph that the inventory itself proves: what the root holds, and which
linked libraries each binary names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import URN, component_ref
from ..functions.text import base_name, has_token, lower, present, trim
from ..shared import saved

HEADER, TABLE = "binary-header", "binary-dependency-table"
_URN = f"{URN}:component:"


def packed(ref: Column) -> Column:
    """A reference as bytes, a component's URN by its digest alone; unpacked() is its inverse."""
    digest = F.unhex(F.substring(ref, len(_URN) + 1, 32))
    short = F.concat(F.lit(_URN), F.lower(F.hex(digest))) == ref
    return F.when(short, F.concat(F.lit(b"\x00"), digest)).otherwise(F.concat(F.lit(b"\x01"), ref.cast("binary")))


def unpacked(c: Column) -> Column:
    rest = F.substring(c, 2, 0x7FFFFFFF)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x00"), F.concat(F.lit(_URN), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))


def _located(components: DataFrame) -> DataFrame:
    """A row per component and path of its evidence, one of no path if it has none: its
    packed reference, and what the steps ask of a row, so that no other text is written."""
    none = F.array().cast("array<string>")
    places = F.array_distinct(F.array_remove(F.concat(F.array(present("source_artifact")), F.coalesce("evidence_paths", none)), ""))
    parser = lower(present("source_parser"))
    rows = components.withColumn("ref", component_ref()).select(
        packed(F.col("ref")).alias("ref"),
        lower(trim(F.col("name"))).alias("low"),
        "source_artifact",
        (parser == HEADER).alias("header"),
        (parser == TABLE).alias("listed"),
        present("source_parser").rlike(r"[^\x00-\x20]").alias("parsed"),
        has_token(F.col("dependency_scope"), "runtime").alias("runtime"),
        "first_ordinal",
        F.explode_outer(places).alias("path"),
    )
    within = lower(F.col("path")).contains(F.col("low"))  # few are, and only their base names are taken
    return rows.select(
        "ref", "path", "header", "listed", "parsed", "runtime", "first_ordinal",
        (within & (F.col("low") == lower(base_name(F.col("path"))))).alias("named"),
        (F.col("header") & (F.col("path") == F.col("source_artifact"))).alias("own"),
    )


def dependency_edges(components: DataFrame, artifacts: DataFrame, root_ref: str, promoted_ref: str | None = None) -> DataFrame:
    """(owner_ref, dep_ref), distinct; an owner without dependencies has a null dep_ref.

    components: columns of a component and first_ordinal; artifacts: relative_path and
    parser. All joins are on paths or references. Where several components claim a
    binary's path, header rows win, then the first. The components are read once, and meet
    the paths of binaries once: what several steps need is written between them.
    """
    rows = saved(_located(components), "located")
    listed = artifacts.where((lower(present("parser")) == HEADER) & (F.col("relative_path") != "")).select(F.col("relative_path").alias("path"))
    claims = rows.where("path is not null and (named or own)").select("path", "ref", "header", "own", "named", "first_ordinal", F.lit(False).alias("binary"))
    preference = F.when(F.col("named"), F.struct((~F.col("header")).cast("int").alias("later"), F.col("first_ordinal")))
    places = (
        claims.unionByName(listed.withColumn("binary", F.lit(True)), allowMissingColumns=True)
        .groupBy("path")
        .agg(
            F.max("binary").alias("binary"),
            F.min_by("ref", preference).alias("by_name"),
            F.min_by("ref", F.when(F.col("own"), F.col("first_ordinal"))).alias("by_header"),
        )
        .where("binary or by_header is not null")  # a binary, or what a header says is one
        .select("path", F.coalesce(F.when(F.col("binary"), F.col("by_name")), "by_header").alias("owner_ref"))
    )
    places = saved(places, "places")
    met = saved(
        rows.select("path", "ref", "header", "parsed", "runtime", (F.col("header") | F.col("listed")).alias("read"))
        .join(places.withColumn("found", F.lit(True)), "path", "left")
        .select("ref", "owner_ref", "header", "parsed", "runtime", (F.col("read") | F.col("found").isNotNull()).alias("derived")),
        "met",
    )  # a component at a binary's path, or that its parser read from one, is derived
    linked = saved(met.where("runtime and ref <> owner_ref").select("owner_ref", F.col("ref").alias("dep_ref")).distinct(), "linked")
    every_owner = places.where("owner_ref is not null").select("owner_ref").unionByName(met.where("header").select(F.col("ref").alias("owner_ref"))).distinct()
    alone = every_owner.join(linked, "owner_ref", "left_anti").select("owner_ref", F.lit(None).cast("binary").alias("dep_ref"))

    direct = met.groupBy("ref").agg(F.max("parsed").alias("parsed"), F.max("derived").alias("derived")).where("parsed and not derived")
    held = direct.select(F.lit(root_ref).alias("owner_ref"), unpacked(F.col("ref")).alias("dep_ref"))
    if promoted_ref is not None:
        held = held.where(F.col("dep_ref") != promoted_ref)
    named = linked.unionByName(alone).select(*[unpacked(F.col(c)).alias(c) for c in ("owner_ref", "dep_ref")])
    return held.unionByName(named)


def dependency_sets(edges: DataFrame) -> DataFrame:
    """One row per owner: its dependencies, sorted."""
    return edges.groupBy("owner_ref").agg(F.sort_array(F.collect_set("dep_ref")).alias("depends_on"))


def dependency_digests(edges: DataFrame) -> DataFrame:
    """One row per owner: the number n of its dependencies, and the SHA-256 of them, sorted
    and joined by commas. Spark sorts them, and an owner's pass by as a stream: the root
    may hold any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, n, last, state = None, 0, None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, dep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != owner:
                    if owner is not None:
                        done.append((owner, n, state.hexdigest()))
                    owner, n, last, state = key, 0, None, hashlib.sha256()
                if dep is not None and dep != last:
                    state.update(b"," + dep if n else dep)
                    n, last = n + 1, dep
            yield _digests(done)
        yield _digests([] if owner is None else [(owner, n, state.hexdigest())])

    by = F.xxhash64("owner_ref")  # references begin alike: this tells most owners apart at once
    rows = edges.select("owner_ref", F.col("dep_ref").cast("binary").alias("dep_ref"))
    return rows.repartition("owner_ref").sortWithinPartitions(by, "owner_ref", "dep_ref").mapInArrow(run, "owner_ref string, n long, digest string")


def _digests(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    kinds = {"owner_ref": pa.string(), "n": pa.int64(), "digest": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def sole_project(components: DataFrame) -> DataFrame:
    """The one parsed component of project scope; no row where there are none or more."""
    found = components.where((trim(present("source_parser")) != "") & has_token(F.col("dependency_scope"), "project"))
    one = found.agg(F.min_by(F.struct(*components.columns), "first_ordinal").alias("c"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return one.select("c.*")
