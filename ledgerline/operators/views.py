"""Searchable, faceted, sorted lists of components, artifacts, changes and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.display import change_text, duration_ms, issue_text, needs_review, size_text, status_text
from ..functions.purl import with_lookup
from ..functions.text import contains_text, join_values, lower, present, trim


def _ordered(rows: DataFrame, keys: list[Column], descending: bool) -> DataFrame:
    return rows.orderBy(*[(k.desc() if descending else k.asc()) for k in keys])


def _search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    return rows.where(contains_text(F.concat_ws(" ", *[present(c) for c in columns]), trim_text(needle)))


def trim_text(s: str) -> str:
    return s.strip("".join(map(chr, range(33))))


def _facet(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    return rows if value is None else rows.where(lower(present(column)) == lower(F.lit(value)))


def component_rows(
    components: DataFrame, artifacts: DataFrame, issues: DataFrame, requested: bool = True, complete: bool = True, judged: DataFrame | None = None
) -> DataFrame:
    """Components with the status of their artifact (parsed where it isn't known) and
    their number of issues. Of artifacts with one path the first in order counts. judged:
    the components' distinct_candidates, where they are at hand."""
    status = artifacts.groupBy(F.col("relative_path").alias("source_artifact")).agg(F.min_by("status", "ordinal").alias("status"))
    if judged is None:
        rows = with_lookup(components, present("package_url"))
    else:
        rows = components.join(judged.select("purl", "reason", "canonical"), present("package_url") == F.col("purl")).drop("purl")
    rows = rows.join(status, "source_artifact", "left").join(issues, "package_url", "left")
    rows = rows.withColumns({"status": F.coalesce("status", F.lit("parsed")), "issues": F.coalesce("issues", F.lit(0)).cast("long")})
    return rows.withColumns(
        {
            "known_issues": issue_text(F.lit(requested), F.lit(complete), F.col("reason") == "", F.col("issues")),
            "licenses": join_values(F.col("declared_licenses")),
            "publishers": join_values(F.col("declared_publishers")),
        }
    ).drop("reason", "canonical")


COMPONENT_SEARCH = ["name", "version", "ecosystem", "component_type", "status", "known_issues", "licenses", "publishers", "dependency_scope", "source_artifact"]
COMPONENT_SORTS = ["name", "version", "ecosystem", "component_type", "status", "issues", "licenses", "publishers", "dependency_scope", "source_artifact"]


def component_list(rows: DataFrame, search: str = "", ecosystem: str | None = None, status: str | None = None, sort: str = "name", descending: bool = False) -> DataFrame:
    """Filtered and sorted component rows; descending reverses the tie-break too."""
    rows = _search(_facet(_facet(rows, "ecosystem", ecosystem), "status", status), COMPONENT_SEARCH, search)
    key = F.col(sort) if sort == "issues" else lower(present(sort))
    return _ordered(rows, [key, F.col("first_ordinal")], descending)


ARTIFACT_SEARCH = ["relative_path", "artifact_type", "ecosystem", "status", "parser"]


def artifact_list(rows: DataFrame, search: str = "", artifact_type: str | None = None, status: str | None = None, sort: str = "relative_path", descending: bool = False) -> DataFrame:
    rows = _search(_facet(_facet(rows, "artifact_type", artifact_type), "status", status), ARTIFACT_SEARCH, search)
    key = F.col(sort) if sort == "file_size" else lower(present(sort))
    return _ordered(rows, [key, F.col("relative_path")], descending)


CHANGE_SEARCH = ["kind", "name", "ecosystem", "component_type", "before_version", "after_version", "before_package_url", "after_package_url", "before_scope", "after_scope", "identity_key"]


def change_list(rows: DataFrame, search: str = "", kind: str | None = None, sort: str = "name", descending: bool = False) -> DataFrame:
    rows = _search(_facet(rows, "kind", kind), CHANGE_SEARCH, search)
    return _ordered(rows, [lower(present(sort)), present(sort), F.col("row_key")], descending)


def _line(*values: Column | str) -> Column:
    return F.array_join(F.array(*[present(v) for v in values]), "\t").alias("line")


def change_lines(rows: DataFrame) -> DataFrame:
    """row_key and a tab-separated line of each change, for pasting into tables."""
    return rows.select("row_key", _line(change_text(F.col("kind")), "name", "before_version", "after_version", "ecosystem", "component_type", "identity_key"))


def component_lines(rows: DataFrame) -> DataFrame:
    """first_ordinal and a tab-separated line of each row of component_rows()."""
    shown = status_text(F.col("status"))
    return rows.select("first_ordinal", _line("name", "version", "ecosystem", "component_type", shown, "known_issues", "licenses", "publishers", "dependency_scope", "source_artifact"))


def artifact_lines(rows: DataFrame) -> DataFrame:
    """relative_path and a tab-separated line of each artifact."""
    size = size_text(F.coalesce("file_size", F.lit(0)))
    return rows.select("relative_path", _line("relative_path", "artifact_type", status_text(F.col("status")), "message", size, "ecosystem", "sha256"))


def facets(rows: DataFrame, column: str) -> DataFrame:
    """The column's distinct non-empty values, sorted without regard to case."""
    return rows.where(present(column) != "").select(F.col(column).alias("value")).distinct().orderBy(lower(F.col("value")), "value")


def task_rows(tasks: DataFrame) -> DataFrame:
    """Tasks with their duration, number of messages, and whether they need a review."""
    review = needs_review(F.col("status"), F.col("warnings"), F.col("errors"), F.col("files_inspected"), F.col("matches"))
    return tasks.withColumns(
        {
            "duration_ms": duration_ms(F.col("created_utc"), F.col("completed_utc")),
            "messages": (F.col("warnings") + F.col("errors") + F.col("matches")).cast("long"),
            "needs_review": review,
        }
    )


def task_list(tasks: DataFrame, search: str = "") -> DataFrame:
    rows = _search(tasks, ["created_utc", "target_root_name", "status", "id"], search)
    return rows.orderBy(F.desc("created_utc"), "id")


def _completed(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'completed'")


def previous_of_target(tasks: DataFrame) -> DataFrame:
    """Each completed task with the completed one before it on the same target."""
    own = W.partitionBy(trim(present("target_root_name"))).orderBy("created_utc", F.desc("id"))
    return _completed(tasks).select("id", "target_root_name", "created_utc", F.lag("id").over(own).alias("previous_id"))


def initial_selection(tasks: DataFrame) -> DataFrame:
    """One row: the newest completed task, and what to compare it with: the newest older
    one of its target, else the newest older one. Found by two aggregates; ids break
    ties, the smaller first."""
    done = _completed(tasks).select("id", "created_utc", trim(present("target_root_name")).alias("target"))
    newest = done.agg(F.max("created_utc").alias("created")).join(done, F.col("created") == F.col("created_utc"))
    newest = newest.agg(F.min_by(F.struct("id", "target", "created_utc"), "id").alias("n"))
    older = done.join(F.broadcast(newest)).where(F.col("id") != F.col("n.id"))
    same = F.col("target") == F.col("n.target")
    rank = lambda keep: F.max(F.when(keep, F.col("created_utc")))
    best = older.agg(rank(same).alias("same_at"), rank(F.lit(True)).alias("any_at"))
    chosen = older.join(F.broadcast(best)).where(
        F.when(F.col("same_at").isNotNull(), same & (F.col("created_utc") == F.col("same_at"))).otherwise(F.col("created_utc") == F.col("any_at"))
    )
    base = chosen.agg(F.min("id").alias("baseline_id"))
    return newest.join(F.broadcast(base)).select(F.col("n.id").alias("comparison_id"), "baseline_id")


def summary(components: DataFrame, artifacts: DataFrame, found: DataFrame) -> DataFrame:
    """One row of totals over a scan."""
    c = components.agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("package_url") != "").alias("with_package_url"))
    a = artifacts.agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(F.col("status") == "failed").alias("failed_artifacts"))
    m = found.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("advisory_id").alias("advisories"))
    return c.join(a).join(m)
