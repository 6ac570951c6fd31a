"""The inventory document: one JSON object per component, the primary component, the
dependency entries and the metadata, as rows that sort into a document."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.spdx import is_valid_expression
from ..functions.text import lower, present, trim
from ..functions.versions import soname_abi
from ..shared import saved
from .graph import dependency_edges, dependency_sets, sole_project
from .normalize import sort_order

PREFIX = "ledgerline"
SPEC_VERSIONS = ("1.6", "1.7")
MAX_TEXT_BYTES = 64 << 20


class TooLarge(ValueError):
    """A document that is not rendered as one text."""


@dataclass(frozen=True)
class Task:
    """What a document states about its scan."""

    id: str
    timestamp: str = ""
    target_directory: str = ""
    target_root_name: str = ""
    author_organization: str = ""
    author_email: str = ""
    include_absolute_paths: bool = False
    scanner_version: str = "0"
    files_inspected: int = 0
    tools: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        """The target folder's base name, else the stored one's."""
        for value in (self.target_directory, self.target_root_name):
            base = value.strip().replace("\\", "/").rstrip("/").rpartition("/")[2]
            if base and base not in (".", "..") and not (len(base) == 2 and base[1] == ":"):
                return base
        return "scanned-project"


def valid_email(value: str) -> bool:
    value = value.strip()
    local, at, domain = value.partition("@")
    bad = any(ord(c) <= 32 or c in "<>()[],;" for c in value)
    return bool(
        at and local and domain and len(value) <= 254 and "@" not in domain and not bad and ".." not in value
        and local[0] != "." and local[-1] != "." and domain[0] not in ".-" and domain[-1] not in ".-"
    )


def output_path(path: Column, task: Task) -> Column:
    """Root-relative with forward slashes, or absolute where the scan asks for it."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    if not task.include_absolute_paths:
        return slashed
    return F.concat(F.lit(task.target_directory.replace("\\", "/").rstrip("/") + "/"), slashed)


def _some(values: Column) -> Column:
    """An array, or null where it is empty: null members don't appear in the JSON."""
    return _bound(values, lambda v: F.when(F.size(v) > 0, v))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _text(name: str) -> Column:
    return F.nullif(present(name), F.lit(""))


def _properties(task: Task) -> Column:
    """name and value pairs, distinct and sorted: by name here, each name's values as
    texts, which are told apart by their hashes."""
    pair = lambda n, v: F.struct(F.lit(f"{PREFIX}:{n}").alias("name"), v.alias("value"))
    many = lambda values: F.sort_array(F.array_distinct(values))
    native = (lower(present("ecosystem")) == "native") & F.col("package_url").startswith("pkg:generic/")
    values = {
        "ecosystem": F.array(present("ecosystem")),
        "source-artifact": F.array(F.when(present("source_artifact") == "", "").otherwise(output_path(present("source_artifact"), task))),
        "source-parser": F.array(present("source_parser")),
        "dependency-scope": F.array(present("dependency_scope")),
        "binary-package-url-evidence": F.array(F.when(native, "binary name + exact fixed version + verified SHA-256").otherwise("")),
        "cpe-evidence": F.array(present("cpe_evidence")),
        "pe-company-name": F.array(present("company_name")),
        "pe-product-name": F.array(present("product_name")),
        "elf-soname": F.array(present("native_soname")),
        "elf-build-id": F.array(present("native_build_id")),
        "requested-range": F.array(identity.requested_range()),
        "soname-abi-version": F.array(soname_abi(F.col("ecosystem"), F.col("name"))),
        "evidence-path": many(F.transform("evidence_paths", lambda p: output_path(p, task))),
        "declared-hash-provenance": many(F.transform("declared_hashes", lambda h: F.to_json(h))),
    }
    pairs = lambda n: F.transform(values[n], lambda v: pair(n, v))
    return F.filter(F.concat(*[pairs(n) for n in sorted(values)]), lambda p: p["value"] != "")


def _hashes() -> Column:
    """The component's own SHA-256 and its declared digests, each once."""
    own = F.when(present("sha256") != "", F.array(F.struct(F.lit("SHA-256").alias("alg"), lower(present("sha256")).alias("content"))))
    declared = F.transform("declared_hashes", lambda h: F.struct(h["algorithm"].alias("alg"), lower(h["digest"]).alias("content")))
    none = F.array().cast("array<struct<alg:string,content:string>>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(own, none), declared.cast("array<struct<alg:string,content:string>>"))))


def _licenses() -> Column:
    """One valid license expression, else a list of named licenses."""
    kind = "array<struct<expression:string,license:struct<name:string,acknowledgement:string>,acknowledgement:string>>"
    values = F.col("declared_licenses")
    one = F.array(F.struct(values[0], F.lit(None).cast("struct<name:string,acknowledgement:string>"), F.lit("declared"))).cast(kind)
    many = F.transform(values, lambda v: F.struct(F.lit(None).cast("string"), F.struct(v, F.lit("declared")), F.lit(None).cast("string"))).cast(kind)
    return F.when((F.size(values) == 1) & is_valid_expression(F.get(values, 0)), one).otherwise(_some(many))


def component_object(task: Task) -> Column:
    """A component as a struct in the members' order; absent members are null."""
    exact = identity.has_exact_version()
    paths = F.sort_array(F.array_distinct(F.filter(F.concat(F.array(present("source_artifact")), F.col("evidence_paths")), lambda p: p != "")))
    occurrences = lambda p: F.transform(p, lambda x: F.struct(output_path(x, task).alias("location")))
    return F.struct(
        F.col("component_type").alias("type"),
        identity.component_ref().alias("bom-ref"),
        F.col("name").alias("name"),
        F.nullif(F.array_join("declared_publishers", "; "), F.lit("")).alias("publisher"),
        _licenses().alias("licenses"),
        F.when(exact, F.col("version")).alias("version"),
        F.nullif(identity.document_scope(), F.lit("")).alias("scope"),
        F.when(exact, _text("package_url")).alias("purl"),
        _text("cpe").alias("cpe"),
        _some(_hashes()).alias("hashes"),
        _some(_properties(task)).alias("properties"),
        _bound(paths, lambda p: F.when(F.size(p) > 0, F.struct(occurrences(p).alias("occurrences")))).alias("evidence"),
    )


def document_rows(task: Task, components: DataFrame, artifacts: DataFrame, spec_version: str = "1.7") -> DataFrame:
    """section, rank, json: metadata (one row), component rows in list order, dependency
    rows with the root first. An owner's dependencies are one list here; document_lines()
    has none."""
    parts = _sections(task, components, artifacts, spec_version)
    first = components.sparkSession.createDataFrame([("head", "", json.dumps(parts.head, ensure_ascii=False))], "section string, rank string, json string")
    entry = F.to_json(F.struct(F.col("owner_ref").alias("ref"), F.col("depends_on").alias("dependsOn")))
    graph = dependency_sets(parts.edges).select(F.lit("dependency").alias("section"), _owner_rank(parts).alias("rank"), entry.alias("json"))
    return first.unionByName(parts.found).unionByName(parts.body).unionByName(graph)


@dataclass
class _Parts:
    """head: what is stated once; rows of artifacts and components (section, rank, json);
    edges of the graph; the primary component's reference."""

    head: dict
    found: DataFrame
    body: DataFrame
    edges: DataFrame
    primary: str


def _owner_rank(parts: _Parts) -> Column:
    return F.concat(F.when(F.col("owner_ref") == parts.primary, "0").otherwise("1"), F.col("owner_ref"))


def artifact_rows(task: Task, artifacts: DataFrame) -> DataFrame:
    """section, rank, json of a document's artifacts, which nothing else of it changes."""
    listed = artifacts.select(
        F.concat_ws(" | ", output_path(F.col("relative_path"), task), "artifact_type", "status", F.nullif("parser", F.lit(""))).alias("value"), "relative_path", "artifact_type"
    )
    return listed.select(
        F.lit("artifact").alias("section"), F.concat_ws("\x01", "relative_path", "artifact_type").alias("rank"),
        F.to_json(F.struct(F.lit(f"{PREFIX}:artifact").alias("name"), F.col("value"))).alias("json"),
    )


def _sections(task: Task, components: DataFrame, artifacts: DataFrame, spec_version: str) -> _Parts:
    if spec_version not in SPEC_VERSIONS:
        raise ValueError(f"unknown version {spec_version}")
    spark = components.sparkSession
    project = sole_project(components)
    promoted = project.select(component_object(task).alias("c"), "first_ordinal").first()  # one row at most
    root = spark.range(1).select(identity.root_ref(F.lit(task.name)).alias("r")).first()["r"]
    primary = {"type": "application", "bom-ref": root, "name": task.name}
    if promoted is not None:
        primary = {k: v for k, v in promoted["c"].asDict(recursive=True).items() if v is not None}
        primary = _pruned(primary) | {"type": "application", "name": task.name}
        components = components.where(F.col("first_ordinal") != promoted["first_ordinal"])
    author = {"name": task.author_organization.strip(), "email": task.author_email.strip() if valid_email(task.author_email) else ""}
    author = {k: v for k, v in author.items() if v and len(v) <= 4096}
    metadata = {
        "timestamp": task.timestamp,
        "lifecycles": [{"phase": "post-build"}],
        **({"authors": [author]} if author else {}),
        "component": primary,
        "tools": {"components": [{"type": "application", "name": PREFIX, "version": task.scanner_version}]},
        "properties": [
            {"name": f"{PREFIX}:inspection-method", "value": "static inspection"},
            *([{"name": f"{PREFIX}:binary-evidence-readers", "value": ", ".join(task.tools)}] if task.tools else []),
            {"name": f"{PREFIX}:completeness", "value": "best effort"},
            {"name": f"{PREFIX}:files-inspected", "value": str(task.files_inspected)},
        ],
    }
    head = {
        "$schema": f"https://cyclonedx.org/schema/bom-{spec_version}.schema.json",
        "bomFormat": "CycloneDX",
        "specVersion": spec_version,
        "serialNumber": f"urn:uuid:{task.id}",
        "version": 1,
        "metadata": metadata,
        "compositions": [{"aggregate": "incomplete"}],
    }
    order = F.concat_ws("\x01", *[k.cast("string") for k in sort_order()[:-1]], F.lpad(F.col("first_ordinal").cast("string"), 20, "0"))
    body = components.select(F.lit("component").alias("section"), order.alias("rank"), F.to_json(component_object(task)).alias("json"))
    edges = dependency_edges(components, artifacts, primary["bom-ref"], primary["bom-ref"] if promoted is not None else None)
    return _Parts(head, artifact_rows(task, artifacts), body, edges, primary["bom-ref"])


LINES = "part int, k1 string, k2 string, text string"


def document_lines(task: Task, components: DataFrame, artifacts: DataFrame, spec_version: str = "1.7") -> DataFrame:
    """The document's text as rows of whole lines, in the order of part, k1 and k2: equal to
    render(), at any size. No list is held; what ends a list knows that it does by the
    list's greatest key."""
    parts = _sections(task, components, artifacts, spec_version)
    spark = components.sparkSession
    own = F.concat("rank", F.lit("\x01"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))  # none twice
    found, body = saved(parts.found.withColumn("rank", own), "artifacts"), saved(parts.body.withColumn("rank", own), "components")
    edges = parts.edges.withColumn("k1", _owner_rank(parts))
    root = spark.createDataFrame([(parts.primary, None)], "owner_ref string, dep_ref string").withColumn("k1", _owner_rank(parts))
    edges = saved(edges.unionByName(root.select(edges.columns)).distinct(), "edges")
    ends = {n: df.agg(F.max("rank").alias("last")).first()["last"] for n, df in (("artifact", found), ("component", body))}
    owners = saved(edges.groupBy("k1", "owner_ref").agg(F.max("dep_ref").alias("last")), "owners")
    last_owner = owners.agg(F.max("k1")).first()[0]

    head = json.loads(json.dumps(parts.head))
    compositions = head.pop("compositions")
    frame = json.dumps(head | {"components": [0], "dependencies": [0], "compositions": compositions}, indent=2, ensure_ascii=False).split("\n")
    at = next(k for k, line in enumerate(frame) if line == '  "components": [')
    close = at - 1 - frame[at - 1 :: -1].index("    ]")  # of the properties, which end the metadata
    comma = "," if ends["artifact"] is not None else ""
    some = ends["component"] is not None
    fixed = [
        (0, "\n".join(frame[: close - 1] + [frame[close - 1] + comma])),
        (2, "\n".join([*frame[close:at], frame[at] if some else '  "components": [],'])),
        *([(4, frame[at + 2])] if some else []),
        (5, frame[at + 3]),
        (7, "\n".join(frame[at + 5 :])),
    ]
    rows = spark.createDataFrame([(p, "", "", t) for p, t in fixed], LINES)

    def items(df: DataFrame, part: int, depth: int, last: str | None) -> DataFrame:
        given = df.select(F.lit(part).alias("part"), F.col("rank").alias("k1"), F.lit("").alias("k2"), "json", (F.col("rank") != F.lit(last)).alias("more"))
        return _formatted(given, depth)

    lone = owners.where("last IS NULL")
    held = owners.where("last IS NOT NULL")
    opened = _formatted(owners.select(F.lit(6).alias("part"), "k1", F.lit("0").alias("k2"), F.to_json(F.struct("owner_ref")).alias("json"), F.col("last").isNotNull().alias("more")), -1)
    linked = edges.where("dep_ref IS NOT NULL").join(owners.select("k1", "last"), "k1")
    linked = _formatted(linked.select(F.lit(6).alias("part"), "k1", F.concat(F.lit("1"), "dep_ref").alias("k2"), F.to_json(F.struct("dep_ref")).alias("json"), (F.col("dep_ref") != F.col("last")).alias("more")), -2)
    comma_or_not = F.when(F.col("k1") == F.lit(last_owner), "    }").otherwise("    },")
    ended = held.select(F.lit(6).alias("part"), "k1", F.lit("2").alias("k2"), F.concat(F.lit("      ]\n"), comma_or_not).alias("text")).unionByName(
        lone.select(F.lit(6).alias("part"), "k1", F.lit("2").alias("k2"), comma_or_not.alias("text"))
    )
    for more in (items(found, 1, 6, ends["artifact"]), items(body, 3, 4, ends["component"]), opened, linked, ended):
        rows = rows.unionByName(more)
    return rows


def _formatted(rows: DataFrame, depth: int) -> DataFrame:
    """(part, k1, k2, text) of rows (part, k1, k2, json, more): the value's lines at a depth
    of blanks, with a comma if more follow. -1: an owner's first lines, which open its list
    if more; -2: one of its dependencies."""

    def text(value: str, more: bool) -> str:
        found = json.loads(value)
        if depth == -1:
            ref = json.dumps(found["owner_ref"], ensure_ascii=False)
            return f'    {{\n      "ref": {ref},\n      "dependsOn": [' + ("" if more else "]")
        if depth == -2:
            return " " * 8 + json.dumps(found["dep_ref"], ensure_ascii=False) + ("," if more else "")
        lines = json.dumps(found, indent=2, ensure_ascii=False).split("\n")
        return "\n".join(" " * depth + x for x in lines) + ("," if more else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text(j, m) for j, m in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["part", "k1", "k2", "text"])

    return rows.mapInArrow(run, LINES)


def write_lines(lines: DataFrame, folder: str) -> DataFrame:
    """Writes document_lines as text files whose names give their order, and returns path,
    n_bytes and offset of each in the document. The sort deals ranges, so parts are written
    by all tasks at once."""
    spark = lines.sparkSession
    lines.orderBy("part", "k1", "k2").select("text").write.text(folder)
    sizes = spark.read.text(f"{folder}/part-*").groupBy(F.input_file_name().alias("path"), F.lit(0).alias("all")).agg(F.sum(F.octet_length("value") + 1).alias("n_bytes"))
    before = Window.partitionBy("all").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return sizes.select("path", "n_bytes", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("offset"))


def assemble(parts: DataFrame, path: str) -> int:
    """One file of the parts of write_lines, on a folder that every executor sees as a local
    one: each task copies its parts to their place, and the file gets its name when all
    are there. Returns its size."""
    unfinished = f"{path}.{uuid.uuid4().hex}.part"
    total = parts.agg(F.sum("n_bytes")).first()[0] or 0
    with open(unfinished, "xb") as f:
        f.truncate(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, offset in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with open(unquote(urlsplit(source).path), "rb") as given, open(unfinished, "r+b") as out:
                    out.seek(offset)
                    shutil.copyfileobj(given, out, 1 << 20)
                    out.flush()
                    os.fsync(out.fileno())
            yield batch

    try:
        parts.repartition("path").mapInArrow(run, parts.schema).count()
        os.replace(unfinished, path)
    finally:
        if os.path.exists(unfinished):
            os.unlink(unfinished)
    return total


def _pruned(value):
    if isinstance(value, dict):
        return {k: _pruned(v) for k, v in value.items() if v is not None}
    return [_pruned(v) for v in value] if isinstance(value, list) else value


def render(rows: DataFrame) -> str:
    """The document's text: two-space indent, final line feed. For documents of at most
    MAX_TEXT_BYTES, which is checked before anything is collected; larger ones stay rows."""
    size = rows.agg(F.sum(F.octet_length("json"))).first()[0] or 0
    if size > MAX_TEXT_BYTES:
        raise TooLarge(f"{size} bytes; write its lines instead")
    parts: dict[str, list] = {"head": [], "artifact": [], "component": [], "dependency": []}
    for r in rows.orderBy("section", "rank").collect():
        parts[r["section"]].append(json.loads(r["json"]))
    (head,) = parts["head"]
    compositions = head.pop("compositions")
    head["metadata"]["properties"] += parts["artifact"]
    root = {(d["ref"]): d for d in parts["dependency"]}
    primary = head["metadata"]["component"]["bom-ref"]
    root.setdefault(primary, {"ref": primary, "dependsOn": []})
    ordered = [root.pop(primary), *[root[k] for k in sorted(root)]]
    document = head | {"components": parts["component"], "dependencies": ordered, "compositions": compositions}
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"
