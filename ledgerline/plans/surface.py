"""Registered queries of checks, references, documents, readiness, evidence cache and
history, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, evidence, hashes, identity, purl
from ..operators import cache, document, normalize, readiness
from ..shared import saved, spread
from ..sources import adapters
from ..streaming import history

STATUSES = ("Completed", "RUNNING", "failed", "cancelled", "paused", "", " completed", "Parsed", "partially parsed", "detected but unsupported", "FAILED")
HASH_NAMES = ("SHA-1", "SHA-256", "SHA-512", "MD5")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cols() -> tuple[Column, Column]:
    return F.col("p_partkey"), F.col("p_size")


def hash_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of parts' names under an algorithm that may be another one."""
    key, size = _cols()
    digest = F.when(key % 3 == 0, F.sha1("p_name")).when(key % 3 == 1, F.sha2("p_name", 256)).otherwise(F.upper(F.sha2("p_name", 256)))
    source = F.when(size % 10 == 0, "").otherwise("a.lock")
    h = F.struct(
        adapters._choice(key % 4, HASH_NAMES).alias("algorithm"), digest.alias("digest"), F.col("p_name").alias("subject"),
        source.alias("source_artifact"), F.lit("p").alias("source_parser"),
    )
    return _part(spark, sf_dir).select("p_partkey", hashes.is_valid_hash(h).alias("valid"))


def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, size = _cols()
    given = F.sha2("p_name", 256)
    given = F.when(size % 4 == 0, F.upper(given)).when(size % 4 == 1, F.concat(F.lit(" "), given, F.lit("\n"))).when(size % 4 == 2, F.concat(given, F.lit("0"))).otherwise(given)
    return _part(spark, sf_dir).select("p_partkey", hashes.canonical_sha256(given).alias("digest"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, artifact and version of parts: which are literal, and their package URLs."""
    _, size = _cols()
    group = F.when(size % 7 == 0, "${g}").otherwise(F.concat(F.lit("org.b"), _text("p_size")))
    artifact = F.when(size % 5 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    version = F.when(size % 11 == 0, "[1,2)").otherwise(F.concat(_text("p_size"), F.lit(".0")))
    rows = _part(spark, sf_dir).select("p_partkey", group.alias("g"), artifact.alias("a"), version.alias("v"))
    return rows.select(
        "p_partkey",
        evidence.is_literal_coordinate(F.col("a")).alias("literal"),
        purl.maven_url(F.col("g"), F.col("a"), F.col("v")).alias("pom_url"),
        evidence.archive_url(F.col("g"), F.col("a"), F.col("v")).alias("archive_url"),
    )


def binary_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package URLs and platform names of parts as binaries."""
    _, size = _cols()
    version = F.concat(_text(size % 3), F.lit("."), _text(size % 2))
    digest = F.when(size % 5 == 0, "abc").otherwise(F.upper(F.sha2("p_name", 256)))
    company = F.when(size % 4 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit(" & ")))
    rows = _part(spark, sf_dir).select("p_partkey", "p_name", version.alias("v"), digest.alias("d"), company.alias("c"))
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return rows.select(
        "p_partkey",
        purl.binary_url(name, F.col("v"), F.col("d")).alias("package_url"),
        evidence.evidence_cpe(F.col("c"), F.col("p_name"), F.col("v")).alias("cpe"),
    )


def root_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", identity.root_ref(F.col("url")).alias("ref"))


def path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents: inside of a root, and whether two scans have one target."""
    rows = adapters.paths(spark, sf_dir)
    root = F.when(F.col("doc_id") % 2 == 0, F.concat(F.split_part("relative_path", F.lit("/"), F.lit(1)), F.lit("//"))).otherwise("src")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("relative_path"), F.lit("/"))).when(F.col("doc_id") % 3 == 1, "").otherwise("x")
    folder = F.when(F.col("doc_id") % 6 == 1, "").otherwise(F.col("relative_path"))
    return rows.select(
        "doc_id",
        evidence.is_within(F.col("relative_path"), root).alias("within"),
        evidence.same_target(folder, other, F.lit("a "), F.when(F.col("doc_id") % 4 == 1, "a").otherwise("b")).alias("same"),
    )


def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made from tasks, whether they are safe, and the names of their exports."""
    rows = adapters.tasks(spark, sf_dir)
    h = F.md5("id")
    cut = lambda a, n: F.substring(h, a, n)
    made = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), F.when(F.col("warnings") > 0, cut(21, 11)).otherwise(cut(21, 12)))
    return rows.select(
        "id", evidence.is_task_id(made).alias("is_id"),
        evidence.export_name(F.col("created_utc"), F.concat("target_root_name", F.lit(" / é ")), made).alias("export"),
    )


def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States in any case, some with a part's name or a blank behind them."""
    key, size = _cols()
    text = adapters._choice(key % len(STATUSES), STATUSES)
    cased = F.when(size % 3 == 0, F.upper(text)).when(size % 3 == 1, F.initcap(text)).otherwise(text)
    cased = F.concat(cased, F.when(size % 7 == 0, F.col("p_name")).when(size % 11 == 0, " ").otherwise(""))
    rows = _part(spark, sf_dir).select("p_partkey", cased.alias("s"))
    return rows.select("p_partkey", display.task_status(F.col("s")).alias("task"), display.artifact_status(F.col("s")).alias("artifact"))


def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps made from orders, half of them wrong, and tokens of bounded size."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    stamp = F.concat(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 5 == 0, " ").otherwise("T"), F.when(key % 3 == 0, "25").otherwise("10"),
        F.when(key % 11 == 1, ":00:60").otherwise(":00:00"), F.when(key % 4 == 0, ".25+01:00").when(key % 4 == 1, "Z").when(key % 4 == 2, "z").otherwise(""),
    )
    token = F.when(key % 7 == 0, F.concat("o_orderpriority", F.lit("\t"))).when(key % 7 == 1, F.repeat(F.lit("x"), F.lit(4097))).when(key % 7 == 2, "").otherwise(F.col("o_orderpriority"))
    return orders.select("o_orderkey", readiness.is_timestamp(stamp).alias("is_time"), readiness.is_token(token).alias("is_token"))


# documents

TASK = document.Task("00000000-0000-4000-8000-000000000001", "2024-01-01T00:00:00Z", "/srv/app", "app")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(adapters.components(spark, sf_dir).where("side = 'current'"))


def document_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component objects of a document, flattened."""
    rows = _current(spark, sf_dir).select("first_ordinal", document.component_object(TASK).alias("c"))
    pairs = F.transform("c.properties", lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    return rows.select(
        "first_ordinal", "c.type", F.col("c.bom-ref").alias("ref"), "c.name", "c.version", "c.scope", "c.purl",
        F.get("c.licenses", 0)["expression"].alias("expression"),
        F.array_join(F.filter(F.transform("c.licenses", lambda x: x["license"]["name"]), lambda n: n.isNotNull()), ";").alias("named"),
        F.array_join(pairs, ";").alias("properties"),
        F.array_join(F.col("c.evidence.occurrences.location"), ";").alias("places"),
    )


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.manifests(spark, sf_dir).withColumns({"artifact_type": F.lit("package.json"), "parser": F.lit("package-json")})


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each section of the whole document has, and what the root holds."""
    components = saved(_current(spark, sf_dir), "components")  # for the sole project, the objects and the graph
    rows = document.document_rows(TASK, components, _manifests(spark, sf_dir))
    held = F.size(F.from_json("json", "dependsOn array<string>")["dependsOn"])
    return rows.groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("section") == "dependency", held)), F.lit(0)).cast("long").alias("held")
    )


def document_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document.artifact_rows(TASK, _manifests(spark, sf_dir))
    return rows.select(F.get_json_object("json", "$.name").alias("name"), F.get_json_object("json", "$.value").alias("value"))


# readiness


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inventory document per customer; the key decides which fields it has."""
    c = F.col("c_custkey")
    opt = lambda test, text: F.when(test, text).otherwise("")
    part = (
        F.concat(
            F.lit('{"bom-ref": "c1", "name": "N", "type": "'), F.when(c % 2 == 0, "file").otherwise("library"), F.lit('"'),
            opt(c % 3 == 1, ', "version": "1"'), opt(c % 4 == 1, ', "purl": "pkg:npm/n@1"'),
            opt(c % 5 == 1, ', "licenses": [{"expression": "MIT", "acknowledgement": "concluded"}]'),
            opt(c % 5 == 2, ', "licenses": [{"expression": "MIT", "acknowledgement": "declared"}]'),
            opt(c % 6 == 1, ', "externalReferences": [{"type": "distribution", "url": "https://x/y", "hashes": [{"alg": "SHA-512", "content": "' + "ab" * 64 + '"}]}]'),
            opt(c % 2 == 0, ', "properties": [{"name": "bsi:component:executable", "value": "executable"}, {"name": "bsi:component:archive", "value": "zip"}]'),
            F.lit("}"),
        )
    )
    text = F.concat(
        F.lit('{"bomFormat": "CycloneDX", "specVersion": "'), F.when(c % 4 == 0, "1.5").otherwise("1.6"), F.lit('", '), F.when(c % 8 == 3, "").otherwise(F.concat(F.lit('"serialNumber": "urn:uuid:'), _text(c), F.lit('", '))), opt(c % 7 == 0, '"vulnerabilities": [], '),
        F.lit('"metadata": {'), opt(c % 2 == 0, '"authors": [{"name": "A", "email": "a@b.c"}], '), F.lit('"timestamp": "2024-'),
        F.when(c % 5 == 0, "13").otherwise("12"), F.lit('-01T00:00:00Z", "component": {"type": "application", "bom-ref": "r", "name": "C"}}, "components": ['), part,
        F.lit('], "dependencies": [{"ref": "r", "dependsOn": ["c1"]}'), opt(c % 3 != 0, ', {"ref": "c1", "dependsOn": []}'),
        F.lit('], "compositions": [{"aggregate": "'), F.when(c % 2 == 1, "complete").otherwise("incomplete"), F.lit('"}]}'),
    )
    text = F.when(c % 50 == 0, "{").otherwise(text)  # no document at all
    keys = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    return keys.select(F.col("c_custkey").alias("task_id"), text.alias("json"))


def readiness_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.audit(_documents(spark, sf_dir))


def readiness_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the documents of tasks, with the digests that were kept of them: ids, sizes,
    digests, encodings and JSON that are not what they should be among them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    key = F.col("page_id")
    task = F.concat(F.lit("cccccccc-cccc-4ccc-8ccc-"), F.lpad(_text(key), 12, "0"))
    task = F.when(key % 9 == 1, F.concat(F.lit("{"), task, F.lit("}"))).when(key % 9 == 2, F.col("url")).when(key % 9 == 3, F.upper(task)).otherwise(task)
    sound = F.to_json(F.struct("url", "html"))
    content = (
        F.when(key % 11 == 1, "").when(key % 11 == 2, F.concat(F.lit("["), sound, F.lit("]"))).when(key % 11 == 3, F.concat(F.lit('{"a": 1, "a": '), sound, F.lit("}")))
        .when(key % 11 == 4, F.col("html")).otherwise(sound)
    ).cast("binary")
    content = F.when(key % 11 == 5, F.concat(F.lit(b'{"a": "\xc0\xaf"}'), F.lit(b"").cast("binary"))).otherwise(content)
    digest = F.sha2(content, 256)
    digest = F.when(key % 7 == 1, "").when(key % 7 == 2, F.col("url")).when(key % 7 == 3, F.sha2("url", 256)).when(key % 7 == 4, F.concat(F.lit(" "), F.upper(digest))).otherwise(digest)
    rows = pages.select("page_id", task.alias("task_id"), content.alias("content"), digest.alias("expected_sha256"))
    return readiness.source_errors(rows)


def readiness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.summary(readiness_fields(spark, sf_dir))


def readiness_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.blockers(readiness_fields(spark, sf_dir))


def readiness_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.advisories(readiness_fields(spark, sf_dir)).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


# evidence cache and history


def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files against a snapshot in which some have changed since, or were
    read in another context; with and without refresh."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    files = docs.select(F.concat("source", F.lit("/"), "doc_id").alias("relative_path"), _text("doc_id").alias("identity"), digest.alias("content_sha256"))
    old = docs.select(
        F.concat("source", F.lit("/"), "doc_id").alias("relative_path"), _text("doc_id").alias("identity"),
        F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(digest).alias("content_sha256"),
        F.when(F.col("doc_id") % 5 == 0, "other").otherwise("own").alias("context"), _text(F.length("text")).alias("evidence"),
    )
    out = []
    for refresh in (False, True):
        hits, misses = cache.split(files, old, "own", refresh)
        out += [hits.select("relative_path", F.lit(refresh).alias("refresh"), "evidence"), misses.select("relative_path", F.lit(refresh).alias("refresh"), F.lit(None).cast("string").alias("evidence"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks as a store gives them when it is opened again."""
    return history.cleaned(adapters.tasks(spark, sf_dir)).select("id", "status", "errors", "warnings", "matches")


def history_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's daily totals over all tasks at once."""
    days = history.daily_totals(adapters.tasks(spark, sf_dir))
    return days.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "target_root_name", "scans", "files", "warnings")


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log of tasks, one per user, that change, stay or go."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    given = {"id": F.concat(F.lit("u-"), "user_id"), "status": F.col("event_type"), "files_inspected": F.floor("value")}
    names = [f.split(" ") for f in history.TASK.split(", ")]
    log = events.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names], F.col("event_id").alias("seq"), (F.col("event_id") % 11 == 0).alias("removed"))
    return history.change_events(log)


QUERIES = {
    f.__name__: f
    for f in (
        hash_validity, canonical_digests, coordinates, binary_urls, root_references, path_checks, task_names, status_texts, field_checks,
        document_components, document_sections, document_artifacts, readiness_fields, readiness_sources, readiness_summary, readiness_blockers, readiness_advisories,
        cache_lookups, history_rows, history_days, history_events,
    )
}


def _pick_sql(values, key: str = "p_partkey") -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


#: The rules of readiness: field, requirement, and the SQL of its status for the document,
#: its primary component and its other one.
_M = "CASE WHEN {} THEN 'mapped' ELSE 'blocked' END"
_COMPLETE = "k % 2 = 1 AND k % 3 <> 0"
DOCUMENT_RULES = (
    ("sbom.format", "MUST", _M.format("k % 4 <> 0")), ("sbom.vulnerabilityInformation", "MUST", _M.format("k % 7 <> 0")),
    ("sbom.creator", "MUST", "CASE WHEN k % 2 = 0 THEN 'derivable' ELSE 'blocked' END"), ("sbom.timestamp", "MUST", _M.format("k % 5 <> 0")),
    ("sbom.uri", "MUST_IF_EXISTS", "CASE WHEN k % 8 = 3 THEN 'derivable' ELSE 'mapped' END"), ("sbom.dependencies", "MUST", _M.format(_COMPLETE)), ("sbom.buildEquivalence", "MUST", "'blocked'"),
)
COMPONENT_RULES = (
    ("component.descriptionKind", "MUST", "'blocked'", _M.format("k % 2 = 0")), ("component.descriptionLevel", "MUST", "'blocked'", "'blocked'"),
    ("component.creator", "MUST", "'blocked'", "'blocked'"), ("component.name", "MUST", "'mapped'", "'mapped'"),
    ("component.version", "MUST", "'blocked'", _M.format("k % 3 = 1")), ("component.filename", "MUST", "'blocked'", "'blocked'"),
    ("component.dependencies", "MUST", _M.format(_COMPLETE), _M.format(_COMPLETE)),
    ("component.distributionLicences", "MUST", "'blocked'", _M.format("k % 5 = 1")), ("component.deployableHash", "MUST", "'blocked'", _M.format("k % 6 = 1")),
    ("component.executable", "MUST", "'blocked'", _M.format("k % 2 = 0")), ("component.archive", "MUST", "'blocked'", "'blocked'"),
    ("component.structured", "MUST", "'blocked'", "'blocked'"), ("component.sourceCodeUri", "MUST_IF_EXISTS", "'blocked'", "'blocked'"),
    ("component.deployableUri", "MUST_IF_EXISTS", "'blocked'", _M.format("k % 6 = 1")), ("component.otherIdentifiers", "MUST_IF_EXISTS", "'blocked'", _M.format("k % 4 = 1")),
    ("component.originalLicences", "MUST_IF_EXISTS", "'blocked'", _M.format("k % 5 = 2")), ("component.effectiveLicence", "MAY", "'not-observed'", "'not-observed'"),
    ("component.sourceCodeHash", "MAY", "'not-observed'", "'not-observed'"), ("component.securityTxt", "MAY", "'not-observed'", "'not-observed'"),
    ("component.referencedBom", "MAY", "'not-observed'", "'not-observed'"),
)


def _audit_sql() -> str:
    rows = [("document", "", f, r, s) for f, r, s in DOCUMENT_RULES]
    rows += [("component", "component-000000", f, r, a) for f, r, a, _ in COMPONENT_RULES]
    rows += [("component", "component-000001", f, r, b) for f, r, _, b in COMPONENT_RULES]
    each = "\nUNION ALL ".join(
        f"SELECT k AS task_id, '{scope}' AS scope, '{c}' AS component_id, '{f}' AS field, '{r}' AS requirement, {s} AS status FROM d" for scope, c, f, r, s in rows
    )
    return f"d AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 <> 0), audit AS ({each})"


def oracles(norm: str, tasks: str, paths: str) -> dict[str, str]:
    """SQL; norm, tasks and paths are the shared parts of plans/oracles.py."""
    size, name = "CAST(p_size AS VARCHAR)", "replace(p_name, ' ', '-')"
    cpe_words = "regexp_replace(regexp_replace(lower({}), '[ .,_/&-]+', '_', 'g'), '^_+|_+$', '', 'g')"
    made = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, CASE WHEN warnings > 0 THEN 11 ELSE 12 END)"
    verdict = "CASE WHEN count(*) FILTER (status = 'blocked') > 0 THEN 'blocked' ELSE 'review-required' END"
    fact = "field NOT IN ('component.descriptionKind', 'component.descriptionLevel')"
    pairs = """[{'n': 'ecosystem', 'v': ecosystem}, {'n': 'source-artifact', 'v': source_artifact}, {'n': 'source-parser', 'v': source_parser},
      {'n': 'dependency-scope', 'v': dependency_scope}, {'n': 'pe-company-name', 'v': company_name}] || list_transform(string_split(evidence, ','), lambda e: {'n': 'evidence-path', 'v': e})"""
    return {
        "hash_validity": f"""SELECT p_partkey, p_size % 10 <> 0 AND ((p_partkey % 3 = 0 AND {_pick_sql(HASH_NAMES)} = 'SHA-1') OR (p_partkey % 3 = 1 AND {_pick_sql(HASH_NAMES)} = 'SHA-256')) AS valid FROM part""",
        "canonical_digests": "SELECT p_partkey, CASE WHEN p_size % 4 = 2 THEN '' ELSE sha256(p_name) END AS digest FROM part",
        "coordinates": f"""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '${{g}}' ELSE 'org.b' || {size} END AS g, CASE WHEN p_size % 5 = 0 THEN p_name ELSE {name} END AS a, p_size, {size} || '.0' AS v FROM part)
SELECT p_partkey, NOT contains(a, ' ') AS literal, CASE WHEN p_size % 11 = 0 THEN '' ELSE 'pkg:maven/' || url_encode(g) || '/' || url_encode(a) || '@' || v END AS pom_url,
  CASE WHEN p_size % 11 = 0 OR p_size % 7 = 0 OR contains(a, ' ') THEN '' ELSE 'pkg:maven/' || g || '/' || a || '@' || v END AS archive_url FROM c""",
        "binary_urls": f"""WITH b AS (SELECT *, (p_size % 3) || '.' || (p_size % 2) AS v, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE replace(p_brand, '#', ' & ') END AS c FROM part)
SELECT p_partkey, CASE WHEN v = '0.0' OR p_size % 5 = 0 THEN '' ELSE 'pkg:generic/' || replace(p_name, ' ', '_') || '@' || v || '?checksum=sha256:' || sha256(p_name) END AS package_url,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE 'cpe:2.3:a:' || {cpe_words.format("c")} || ':' || {cpe_words.format("p_name")} || ':' || CASE WHEN v = '0.0' THEN '*' ELSE v END || ':*:*:*:*:*:*:*' END AS cpe FROM b""",
        "root_references": "SELECT page_id, 'urn:ledgerline:application:' || substr(sha256('application' || chr(1) || lower(url)), 1, 32) AS ref FROM pages",
        "path_checks": f"""WITH {paths} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN true ELSE starts_with(relative_path, 'src/') END AS within,
  CASE WHEN doc_id % 6 = 1 THEN doc_id % 4 = 1 ELSE doc_id % 3 = 0 END AS same FROM files""",
        "task_names": f"""WITH {tasks}, h AS (SELECT *, md5(id) AS h FROM tasks)
SELECT id, warnings = 0 AS is_id, strftime(lo, '%Y%m%d_%H%M%S') || '_' || target_root_name || '_' || '_' || {made} || '.cdx.json' AS export FROM h""",
        "status_texts": f"""WITH s AS (SELECT p_partkey, lower({_pick_sql(STATUSES)} || CASE WHEN p_size % 7 = 0 THEN p_name WHEN p_size % 11 = 0 THEN ' ' ELSE '' END) AS s FROM part)
SELECT p_partkey, CASE WHEN s IN ('running', 'completed', 'cancelled', 'failed') THEN s ELSE 'pending' END AS task,
  CASE WHEN s IN ('parsed', 'partially parsed', 'failed') THEN s ELSE 'detected but unsupported' END AS artifact FROM s""",
        "field_checks": "SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 3 AS is_time, o_orderkey % 7 > 2 AS is_token FROM orders",
        "document_components": f"""WITH {norm}, p AS (SELECT *, {pairs} AS pairs FROM norm WHERE side = 'current')
SELECT first_ordinal, component_type AS type, CASE WHEN package_url <> '' THEN package_url ELSE 'urn:ledgerline:component:' ||
    substr(sha256(lower(ecosystem) || chr(1) || lower(name) || chr(1) || version || chr(1) || lower(component_type)), 1, 32) END AS ref, name, version,
  CASE WHEN contains(dependency_scope, 'runtime') THEN NULL WHEN contains(dependency_scope, 'optional') THEN 'optional' WHEN contains(dependency_scope, 'development') THEN 'excluded' END AS scope,
  nullif(package_url, '') AS purl, CASE WHEN licenses IN ('MIT', 'Apache-2.0') THEN licenses END AS expression,
  CASE WHEN licenses = '' THEN NULL WHEN licenses IN ('MIT', 'Apache-2.0') THEN '' ELSE replace(licenses, ',', ';') END AS named,
  array_to_string(list_transform(list_sort(list_distinct(list_filter(pairs, lambda x: x.v <> ''))), lambda x: 'ledgerline:' || x.n || '=' || x.v), ';') AS properties,
  replace(evidence, ',', ';') AS places FROM p""",
        "document_sections": f"""WITH {norm}, c AS (SELECT count(*) AS n FROM norm WHERE side = 'current'),
r AS (SELECT count(DISTINCT CASE WHEN package_url <> '' THEN package_url ELSE lower(ecosystem) || chr(1) || lower(name) || chr(1) || version || chr(1) || lower(component_type) END) AS n FROM norm WHERE side = 'current')
SELECT 'head' AS section, 1 AS n, 0 AS held UNION ALL SELECT 'artifact', count(*), 0 FROM supplier UNION ALL SELECT 'component', n, 0 FROM c UNION ALL SELECT 'dependency', 1, n FROM r""",
        "document_artifacts": """SELECT 'ledgerline:artifact' AS name, 'supplier-' || s_suppkey || '/manifest.json | package.json | ' ||
  ['parsed', 'partially parsed', 'detected but unsupported', 'failed'][s_suppkey % 4 + 1] || ' | package-json' AS value FROM supplier""",
        "readiness_fields": f"""WITH {_audit_sql()} SELECT * FROM audit
UNION ALL SELECT c_custkey, 'source', '', '{readiness.JSON_INVALID}', 'MUST', 'blocked' FROM customer WHERE c_custkey % 50 = 0""",
        "readiness_sources": f"""WITH i AS (SELECT page_id AS k, url, html, 'cccccccc-cccc-4ccc-8ccc-' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS t FROM pages)
SELECT CASE k % 9 WHEN 1 THEN '{{' || t || '}}' WHEN 2 THEN url WHEN 3 THEN upper(t) ELSE t END AS task_id, CASE WHEN k % 9 IN (1, 2) THEN '{readiness.ID_INVALID}'
  WHEN k % 11 = 1 OR k % 11 = 4 AND coalesce(html, '') = '' THEN '{readiness.SIZE_INVALID}' WHEN k % 7 IN (1, 2) THEN '{readiness.HASH_MISSING}' WHEN k % 7 = 3 THEN '{readiness.HASH_MISMATCH}'
  WHEN k % 11 IN (2, 3, 4, 5) THEN '{readiness.JSON_INVALID}' ELSE '' END AS code FROM i""",
        "readiness_summary": f"""WITH {_audit_sql()} SELECT task_id, count(DISTINCT component_id) FILTER (scope = 'component') AS components_assessed, count(*) FILTER (status = 'mapped' AND {fact}) AS mapped,
  count(*) FILTER (status = 'derivable' AND {fact}) AS derivable, count(*) FILTER (status = 'not-observed' AND {fact}) AS not_observed,
  count(*) FILTER (status = 'blocked') AS blocked, {verdict} AS verdict FROM audit GROUP BY task_id""",
        "readiness_blockers": f"WITH {_audit_sql()} SELECT task_id, scope, component_id, field FROM audit WHERE status = 'blocked'",
        "readiness_advisories": f"SELECT c_custkey AS task_id, {len(readiness.ADVISORIES)} AS n FROM customer WHERE c_custkey % 50 <> 0",
        "cache_lookups": """SELECT source || '/' || doc_id AS relative_path, false AS refresh, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN CAST(length(text) AS VARCHAR) END AS evidence FROM documents
UNION ALL SELECT source || '/' || doc_id, true, NULL FROM documents""",
        "history_rows": f"""WITH {tasks} SELECT id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status, errors + CAST(status IN ('pending', 'running') AS BIGINT) AS errors, warnings, matches FROM tasks""",
        "history_events": """WITH l AS (SELECT 'u-' || user_id AS id, event_id AS seq, event_id % 11 = 0 AS removed, event_type || ' ' || floor(value) AS state FROM events),
p AS (SELECT *, coalesce(lag(removed) OVER w, true) AS gone, lag(state) OVER w AS before FROM l WINDOW w AS (PARTITION BY id ORDER BY seq)),
k AS (SELECT id, seq, CASE WHEN removed THEN CASE WHEN NOT gone THEN 'removed' END WHEN gone THEN 'added' WHEN before <> state THEN 'updated' END AS kind FROM p)
SELECT id, seq, kind, row_number() OVER (PARTITION BY id ORDER BY seq) AS revision FROM k WHERE kind IS NOT NULL""",
        "history_days": f"""WITH {tasks} SELECT strftime(lo, '%Y-%m-%d') AS day, target_root_name, count(*) AS scans, CAST(sum(files_inspected) AS BIGINT) AS files, CAST(sum(warnings) AS BIGINT) AS warnings FROM tasks GROUP BY 1, 2""",
    }
