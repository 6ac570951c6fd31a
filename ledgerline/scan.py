"""One scan of a folder tree, from its files to its components and their document.

Each step is written to the work folder and read back: the plans stay small, contents are
read once, and a lost executor costs the tasks it ran and nothing before them. Parsers run
one after the other, only those whose files exist, each over all files of its format.
With a cache folder, files that an earlier scan parsed are hashed but not parsed again.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.evidence import archive_url, evidence_cpe
from .functions.purl import binary_url
from .functions.text import base_name
from .operators import cache, classify, parse
from .operators.graph import HEADER
from .operators.normalize import normalize
from .schemas import ARTIFACT, COMPONENT, COMPONENT_FIELDS
from .settings import Settings
from .sources import binaries, inventory

ARCHIVE, STATIC = "java-archive", "static-library-signature"
#: Suffixes of archives and static libraries, first bytes of binaries.
ARCHIVE_SUFFIXES, STATIC_SUFFIXES = (".jar", ".war", ".ear"), (".a", ".lib")
MAGICS = (b"\x7fELF", b"MZ", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe")
#: Bytes of a binary or archive that is read, and of contents that make one Arrow batch.
MAX_BINARY, BATCH = 256 << 20, 16 << 20
READ = (
    "relative_path string, absolute_path string, artifact_type string, ecosystem string, status string, "
    "file_size bigint, sha256 string, message string, content binary, identity string, content_sha256 string, parser string"
)
#: Fixed value: what a platform name was made from.
CPE_EVIDENCE = "PE VERSIONINFO CompanyName + ProductName; inventory candidate only"
#: Component rows of a file beyond which its evidence is not kept: it is parsed in each scan.
MAX_CACHED_ROWS = 512


@dataclass(frozen=True)
class Scan:
    """artifacts and components (merged, with first_ordinal) of a scan, and the messages
    of what could not be listed."""

    artifacts: DataFrame
    components: DataFrame
    warnings: DataFrame


class Work:
    """A new folder that every executor sees, under spark.checkpoint.dir where it is set."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        self.folder = f"{named or 'file://' + tempfile.mkdtemp(prefix='ledgerline-')}/scan-{uuid.uuid4().hex}"

    def saved(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _sort(path: str, head: bytes) -> tuple[str, str, str] | None:
    """Type, ecosystem and parser of a file that no manifest rule names."""
    low = path.lower()
    if low.endswith(ARCHIVE_SUFFIXES):
        return "Java archive", "Maven", ARCHIVE
    if low.endswith(STATIC_SUFFIXES) and head == b"!<arch>\n":
        return "static library", "native", STATIC
    return ("native binary", "native", HEADER) if head.startswith(MAGICS) else None


def _read(row: dict, digest: bool, keyed: bool) -> tuple | None:
    """A row of READ, or None for what is no artifact. Only with keyed, content_sha256 is
    filled whatever digest says."""
    given = (row["artifact_type"], row["ecosystem"], row["parser"])
    status, message, size = row["status"] or "parsed", row["message"] or "", row["file_size"]
    identity = f"{row['storage_id']}-{row['file_id']}"
    out = lambda s, m, sha="", content=None: (row["relative_path"], row["absolute_path"], *given[:2], s, size, sha if digest else "", m, content, identity, sha, given[2])
    if given[2] and (status == "failed" or given[2] == "license-evidence"):
        return out(status, message)
    try:
        with open(row["absolute_path"], "rb") as f:
            at = os.fstat(f.fileno())
            head = f.read(8)
            if not given[2]:
                found = _sort(row["relative_path"], head)
                if found is None:
                    return None
                given = found
                if size > MAX_BINARY:
                    return out("failed", f"The file exceeds its limit of {MAX_BINARY} bytes.")
            raw = head + f.read()
            after = os.fstat(f.fileno())
    except OSError as e:
        return out("failed", str(e.strerror)) if given[2] else None
    listed = (row["storage_id"], row["file_id"], size, row["mtime_ns"])
    if any((s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns) != listed for s in (at, after)):
        return out("failed", "The file changed during the scan.")
    wanted = status != "detected but unsupported"
    return out(status, message, hashlib.sha256(raw).hexdigest() if digest or keyed else "", raw if wanted else None)


def read_artifacts(files: DataFrame, digest: bool = True, keyed: bool = False) -> DataFrame:
    """Opens classified files of the inventory, and those whose first bytes or suffix make
    them binaries or archives; others are left out. Contents come with their digest and
    only if the file is the one that was listed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for row in b.to_pylist():
                found = _read(row, digest, keyed)
                if found is None:
                    continue
                rows.append(found)
                size += len(found[8] or b"")
                if size > BATCH or len(rows) >= 1000:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    return files.mapInArrow(run, READ)


def _components(rows: DataFrame, **values: Column) -> DataFrame:
    """Component columns, '' or empty where no value is given, with relative_path and place."""
    kinds = dict(f.strip().split(" ", 1) for f in COMPONENT.split(", ") if "array" not in f)
    arrays = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], COMPONENT).schema if f.name not in kinds}
    of = lambda c: values[c] if c in values else F.array().cast(arrays[c]) if c in arrays else F.lit("")
    place = values.get("place", F.lit(0)).cast("long").alias("place")
    return rows.select("relative_path", place, *[of(c).alias(c) for c in COMPONENT_FIELDS])


def _from_manifests(rows: DataFrame) -> DataFrame:
    path = F.col("relative_path")
    stated = [c for c in rows.columns if c in COMPONENT_FIELDS]
    hashes = F.transform("hashes", lambda h: F.struct(h["algorithm"].alias("algorithm"), h["digest"].alias("digest"), h["subject"].alias("subject"), path.alias("source_artifact"), F.col("source_parser").alias("source_parser")))
    return _components(rows, place=F.col("place"), source_artifact=path, evidence_paths=F.array(path), declared_hashes=hashes, **{c: F.coalesce(c, F.lit("")) if rows.schema[c].dataType.typeName() == "string" else F.col(c) for c in stated})


def _from_archives(found: DataFrame) -> DataFrame:
    """An archive with one set of coordinates is that component; any other is one of its
    own, with a row for each set of coordinates inside."""
    path = F.col("relative_path")
    common = {"component_type": F.lit("library"), "ecosystem": F.lit("Maven"), "source_artifact": path, "source_parser": F.lit(ARCHIVE), "evidence_paths": F.array(path)}
    rows = found.where("diagnostic = ''").withColumns({"inner": F.filter("coordinates", lambda c: c["group_id"] != ""), "own": F.get(F.filter("coordinates", lambda c: c["group_id"] == ""), F.lit(0))})
    rows = rows.withColumn("sole", F.when(F.size("inner") == 1, F.col("inner")[0]))
    name = lambda c: F.concat(c["group_id"], F.lit(":"), c["artifact_id"])
    url = lambda c: archive_url(c["group_id"], c["artifact_id"], c["version"])
    sole, own = F.col("sole"), F.col("own")
    title = F.coalesce(name(sole), F.nullif(own["title"], F.lit("")), F.regexp_replace(base_name(path), r"\.[^.]*\z", ""))
    outer = _components(rows, **common, name=title, version=F.coalesce(sole["version"], own["version"], F.lit("")), package_url=F.coalesce(url(sole), F.lit("")), sha256=F.col("sha256"))
    each = rows.where("sole is null").select("relative_path", F.posexplode("inner").alias("at", "c"))
    c = F.col("c")
    return outer.unionByName(_components(each, **common, place=F.col("at") + 1, name=name(c), version=c["version"], package_url=url(c)))


def _from_binaries(files: DataFrame) -> DataFrame:
    rows = binaries.binary_components(files).join(files.select(F.col("relative_path"), "sha256"), F.col("source_artifact") == F.col("relative_path"))
    header = F.col("source_parser") == HEADER
    stated = ("name", "version", "component_type", "ecosystem", "source_artifact", "source_parser", "dependency_scope", "native_soname", "native_build_id", "company_name", "product_name")
    rows = rows.withColumns({"url": F.when(header, binary_url(F.col("name"), F.col("version"), F.col("sha256"))).otherwise(""), "cpe": evidence_cpe(F.col("company_name"), F.col("product_name"), F.col("version"))})
    made = {"package_url": F.col("url"), "cpe": F.col("cpe"), "cpe_evidence": F.when(F.col("cpe") != "", CPE_EVIDENCE).otherwise("")}
    return _components(rows, place=F.when(header, 0).otherwise(1), sha256=F.when(header, F.col("sha256")).otherwise(""), evidence_paths=F.array("source_artifact"), **made, **{c: F.col(c) for c in stated})


def _context(root: str, settings: Settings) -> str:
    at = os.stat(root)
    flags = {"links": settings.follow_symbolic_links, "outside": settings.allow_outside_root, "digests": settings.calculate_sha256}
    return cache.context_hash(os.path.realpath(root), f"{at.st_dev}-{at.st_ino}", list(settings.ignore_patterns), **flags)


def _evidence_type(raw: DataFrame) -> str:
    row = StructType([f for f in raw.schema if f.name not in ("relative_path", "ordinal")])
    return f"struct<outcome:string,note:string,rows:array<{row.simpleString()}>>"


def _evidence(files: DataFrame, results: DataFrame, raw: DataFrame) -> DataFrame:
    """A cache entry per file with an outcome: the outcome and the component rows in order.
    Files with more than MAX_CACHED_ROWS rows have none, so that no list grows beyond it."""
    most = raw.groupBy("relative_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_CACHED_ROWS)
    row = F.struct(*[c for c in raw.columns if c not in ("relative_path", "ordinal")])
    lists = raw.join(most, "relative_path", "left_anti").groupBy("relative_path").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", row.alias("row")))), lambda x: x["row"]).alias("rows")
    )
    told = files.select(*cache.KEY).join(results, "relative_path").join(most, "relative_path", "left_anti")
    evidence = F.struct("outcome", "note", F.coalesce("rows", F.array().cast(_evidence_type(raw).partition("rows:")[2][:-1])).alias("rows"))
    return told.join(lists, "relative_path", "left").select(*cache.KEY, F.to_json(evidence).alias("evidence"))


def scan(spark: SparkSession, root: str, settings: Settings = Settings(), cache_folder: str | None = None) -> Scan:
    """Scans the tree at root, which every executor must see. An empty tree gives empty
    tables; files that can't be read or parsed become artifacts with status failed.

    With a cache folder, which every executor must see too, the outcome of each file is
    kept there once the scan is complete, under its path, identity and the digest of its
    content; a later scan with equal settings takes it from there. Contents are hashed
    anew in every scan. With refresh_rescan_cache everything is parsed, and kept anew."""
    work = Work(spark)
    options = {"path": root, "ignore": "\n".join(settings.ignore_patterns), "followLinks": str(settings.follow_symbolic_links), "allowOutsideRoot": str(settings.allow_outside_root)}
    listed = work.saved(inventory.walk(spark, options).drop("content", "sha256"), "listed")
    files = listed.where("entry_kind = 'file'").drop("message")
    gated = classify.gate(classify.classify(files))
    unnamed = F.col("parser").isNull()  # its first bytes decide
    known = gated.withColumns({c: F.when(unnamed, "").otherwise(F.col(c)) for c in ("status", "message")})
    # a deep or flat tree is listed by few tasks: its files are read by all
    spread = known.repartition("relative_path")
    read = work.saved(read_artifacts(spread, settings.calculate_sha256, cache_folder is not None), "read", "parser")
    open_files = read.where("content is not null")
    parts, results = [], []
    none = _components(listed.where("false"))
    if cache_folder is not None:
        context, known_files = _context(root, settings), open_files.drop("content")
        old = cache.load(spark, cache_folder)
        if old is not None:
            kind = _evidence_type(none)
            hits, _ = cache.split(known_files, old, context, settings.refresh_rescan_cache)
            hits = work.saved(hits.select("relative_path", F.from_json("evidence", kind).alias("e")), "hits")
            parts.append(hits.select("relative_path", F.explode("e.rows").alias("r")).select("relative_path", "r.*"))
            results.append(hits.select("relative_path", "e.outcome", "e.note"))
            open_files = open_files.join(hits.select("relative_path"), "relative_path", "left_anti")
    parsers = [r["parser"] for r in open_files.select("parser").distinct().orderBy("parser").collect()]  # at most one per format
    for p in parsers:
        files = open_files.where(F.col("parser") == p)
        if p in parse.PARSERS:
            texts = files.select("relative_path", "parser", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
            rows = work.saved(parse.components(texts, [p]), f"rows-{p}")
            done = work.saved(parse.outcomes(texts, rows), f"outcomes-{p}")
            rows = _from_manifests(rows.join(done.where("status = 'failed'"), "relative_path", "left_anti"))
        elif p == ARCHIVE:
            found = work.saved(binaries.archive_coordinates(files).join(files.select("relative_path", "sha256"), "relative_path"), f"rows-{p}")
            rows = _from_archives(found)
            done = found.select("relative_path", F.when(F.col("diagnostic") == "", "parsed").otherwise("failed").alias("status"), F.col("diagnostic").alias("message"))
        elif p == HEADER:
            rows = _from_binaries(files)
            found = files.select("relative_path", binaries.binary_evidence("content").alias("b"))
            done = found.select("relative_path", F.when(F.col("b.diagnostic") == "", "parsed").otherwise("failed").alias("status"), F.col("b.diagnostic").alias("message"))
        else:
            path = F.col("relative_path")
            rows = _components(files, component_type=F.lit("library"), ecosystem=F.lit("native"), name=base_name(path), source_artifact=path, source_parser=F.lit(p), sha256=F.col("sha256"), evidence_paths=F.array(path))
            done = files.select("relative_path", F.lit("parsed").alias("status"), F.lit("").alias("message"))
        parts.append(work.saved(rows, f"components-{p}"))
        results.append(done.select("relative_path", F.col("status").alias("outcome"), F.col("message").alias("note")))
    raw = none
    for part in parts:
        raw = raw.unionByName(part)
    ordered = raw.orderBy("relative_path", "source_parser", "place", "name", "version")
    raw = work.saved(ordered.withColumn("ordinal", F.monotonically_increasing_id()), "raw")
    components = work.saved(normalize(raw), "components")
    outcome = listed.where("false").select("relative_path", F.lit("").alias("outcome"), F.lit("").alias("note"))
    for r in results:
        outcome = outcome.unionByName(r)
    counts = raw.groupBy("relative_path").agg(F.count(F.lit(1)).cast("int").alias("component_count"))
    joined = read.drop("content").join(outcome, "relative_path", "left").join(counts, "relative_path", "left")
    shown = F.col("absolute_path") if settings.include_absolute_paths else F.lit("")
    joined = joined.withColumns({"status": F.coalesce("outcome", "status"), "message": F.coalesce("note", "message"), "absolute_path": shown, "component_count": F.coalesce("component_count", F.lit(0))})
    artifacts = work.saved(joined.select(*[f.split(" ")[0] for f in ARTIFACT.split(", ")]), "artifacts")
    if cache_folder is not None:
        cache.commit(spark, work.saved(_evidence(known_files, outcome, raw), "evidence"), cache_folder, context)
    return Scan(artifacts, components, listed.where("message <> ''").select("relative_path", "message"))
