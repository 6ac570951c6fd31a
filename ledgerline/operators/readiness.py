"""Field readiness of inventory documents: which required fields are mapped, derivable or
blocked, as rows of one rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import is_task_id
from ..functions.text import lower, present, trim
from ..shared import saved
from .document import PREFIX
from .strict_json import json_error

MUST, IF_EXISTS, MAY = "MUST", "MUST_IF_EXISTS", "MAY"
MAPPED, DERIVABLE, BLOCKED, UNSEEN = "mapped", "derivable", "blocked", "not-observed"
CONTACT = "struct<name:string,url:array<string>,contact:array<struct<name:string,email:string>>>"
HASH = "struct<alg:string,content:string>"
REFERENCE = f"struct<type:string,url:string,hashes:array<{HASH}>>"
COMPONENT = (
    "struct<type:string,`bom-ref`:string,name:string,version:string,purl:string,cpe:string,swid:struct<tagId:string>,author:string,publisher:string,"
    f"authors:array<struct<name:string,email:string>>,manufacturer:{CONTACT},licenses:array<struct<expression:string,acknowledgement:string>>,"
    f"properties:array<struct<name:string,value:string>>,externalReferences:array<{REFERENCE}>,vulnerabilities:string,components:string>"
)
DOCUMENT = (
    "bomFormat string, specVersion string, serialNumber string, vulnerabilities string, "
    f"metadata struct<timestamp:string,component:{COMPONENT},manufacturer:{CONTACT},authors:array<struct<name:string,email:string>>,author:string,publisher:string>, "
    f"components array<{COMPONENT}>, dependencies array<struct<ref:string,dependsOn:array<string>>>, "
    f"compositions array<struct<aggregate:string,assemblies:array<string>,dependencies:array<string>>>, externalReferences array<{REFERENCE}>"
)
URI = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s]+\z"
EMAIL = r"^[^\s@<>()\[\],;.][^\s@<>()\[\],;]*@[^\s@<>()\[\],;.\-][^\s@<>()\[\],;]*\z"
#: A leap second is allowed, year 0 is not.
RFC3339 = r"^(?!0000)\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+\-]([01]\d|2[0-3]):[0-5]\d)\z"


def is_token(c: Column, limit: int = 4096) -> Column:
    value = present(c)
    return (value != "") & (F.octet_length(value) <= limit) & ~value.rlike(r"[\x00-\x1F\x7F]")


def is_timestamp(c: Column) -> Column:
    value = present(c)
    return value.rlike(RFC3339) & F.try_to_timestamp(F.substring(value, 1, 10)).isNotNull()


def _any(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _contact(manufacturer: Column) -> Column:
    mail = _any(manufacturer["contact"], lambda x: present(x["email"]).rlike(EMAIL))
    return mail | _any(manufacturer["url"], lambda u: present(u).rlike(r"^https?://[^\s]+\z"))


def _other_contact(c: Column) -> Column:
    named = lambda v: present(v).rlike(EMAIL) | present(v).rlike(r"^https?://[^\s]+\z")
    return _any(c["authors"], lambda a: present(a["email"]).rlike(EMAIL)) | named(c["author"]) | named(c["publisher"])


def _creator(c: Column) -> Column:
    return F.when(_contact(c["manufacturer"]), MAPPED).when(_other_contact(c), DERIVABLE).otherwise(BLOCKED)


def _values(c: Column, name: str) -> Column:
    found = F.filter(c["properties"], lambda p: p["name"] == name)
    return F.coalesce(F.transform(found, lambda p: present(p["value"])), F.array().cast("array<string>"))


def _if(test: Column, other: str = BLOCKED) -> Column:
    return F.when(test, MAPPED).otherwise(other)


def _one_of(c: Column, name: str, *allowed: str) -> Column:
    values = _values(c, name)
    return _if((F.size(values) == 1) & F.get(values, 0).isin(*allowed))


def _url(c: Column, kind: str, http: bool = False) -> Column:
    return _any(c["externalReferences"], lambda r: (r["type"] == kind) & present(r["url"]).rlike(r"^https?://[^\s]+\z" if http else URI))


def _sha512(c: Column, kind: str) -> Column:
    good = lambda h: (h["alg"] == "SHA-512") & present(h["content"]).rlike(r"^[0-9A-Fa-f]{128}\z")
    return _any(c["externalReferences"], lambda r: (r["type"] == kind) & _any(r["hashes"], good))


def _licensed(c: Column, how: str) -> Column:
    return _any(c["licenses"], lambda x: (x["acknowledgement"] == how) & is_token(x["expression"]))


def component_rules(c: Column, graph_complete: Column, has_entry: Column) -> list[tuple[str, str, Column]]:
    """(field, requirement, status) in their order."""
    name = _values(c, "bsi:component:filename")
    base = F.get(name, 0)
    effective = _values(c, "bsi:component:effectiveLicence")
    unverified = F.size(_values(c, f"{PREFIX}:declared-hash-provenance")) > 0
    hashes = _any(c["externalReferences"], lambda r: (r["type"] == "source-distribution") & (F.size(r["hashes"]) > 0))
    return [
        ("component.creator", MUST, _creator(c)),
        ("component.name", MUST, _if(is_token(c["name"]))),
        ("component.version", MUST, _if(is_token(c["version"]))),
        ("component.filename", MUST, _if((F.size(name) == 1) & is_token(base) & ~base.rlike(r"[/\\]") & ~base.isin(".", ".."))),
        ("component.dependencies", MUST, _if(graph_complete & has_entry)),
        ("component.distributionLicences", MUST, _if(_licensed(c, "concluded"))),
        ("component.deployableHash", MUST, _if(_sha512(c, "distribution") & ~unverified)),
        ("component.executable", MUST, _one_of(c, "bsi:component:executable", "executable", "non-executable")),
        ("component.archive", MUST, _one_of(c, "bsi:component:archive", "archive", "no archive")),
        ("component.structured", MUST, _one_of(c, "bsi:component:structured", "structured", "unstructured")),
        ("component.sourceCodeUri", IF_EXISTS, _if(_url(c, "source-distribution"))),
        ("component.deployableUri", IF_EXISTS, _if(_url(c, "distribution"))),
        (
            "component.otherIdentifiers", IF_EXISTS,
            _if(is_token(c["purl"]) | (is_token(c["cpe"]) & (F.size(_values(c, f"{PREFIX}:cpe-evidence")) == 0)) | is_token(c["swid"]["tagId"])),
        ),
        ("component.originalLicences", IF_EXISTS, _if(_licensed(c, "declared"))),
        (
            "component.effectiveLicence", MAY,
            F.when((F.size(effective) == 1) & is_token(F.get(effective, 0)), MAPPED)
            .when((F.size(effective) == 0) & (F.size(_values(c, "bsi:component:effectiveLicense")) == 0), UNSEEN)
            .otherwise(BLOCKED),
        ),
        ("component.sourceCodeHash", MAY, F.when(_sha512(c, "source-distribution") & ~unverified, MAPPED).when(hashes, BLOCKED).otherwise(UNSEEN)),
        ("component.securityTxt", MAY, _if(_url(c, "rfc-9116", True), UNSEEN)),
        ("component.referencedBom", MAY, _if(_url(c, "bom"), UNSEEN)),
    ]


def document_rules(d: Column, graph_complete: Column) -> list[tuple[str, str, Column]]:
    m = d["metadata"]
    supported = (d["bomFormat"] == "CycloneDX") & d["specVersion"].isin("1.6", "1.7")
    security = (
        d["vulnerabilities"].isNotNull()
        | _any(d["externalReferences"], lambda r: r["type"] == "advisories")
        | _any(d["components"], lambda c: _any(c["externalReferences"], lambda r: r["type"] == "advisories") | c["vulnerabilities"].isNotNull())
    )
    return [
        ("sbom.format", MUST, F.when(F.coalesce(supported, F.lit(False)), MAPPED).otherwise(BLOCKED)),
        ("sbom.vulnerabilityInformation", MUST, F.when(security, BLOCKED).otherwise(MAPPED)),
        ("sbom.creator", MUST, _creator(m)),
        ("sbom.timestamp", MUST, _if(is_timestamp(m["timestamp"]))),
        ("sbom.uri", IF_EXISTS, _if(present(d["serialNumber"]).rlike(URI), DERIVABLE)),
        ("sbom.dependencies", MUST, _if(graph_complete)),
        ("sbom.buildEquivalence", MUST, F.lit(BLOCKED)),
    ]


#: Why a document isn't assessed.
ID_INVALID, SIZE_INVALID, HASH_MISSING, HASH_MISMATCH, JSON_INVALID = (
    "BSI210-E001-SOURCE-TASK-ID-INVALID", "BSI210-E002-SOURCE-SIZE-INVALID", "BSI210-E003-SOURCE-HASH-MISSING", "BSI210-E004-SOURCE-HASH-MISMATCH",
    "BSI210-E005-SOURCE-JSON-INVALID",
)
MAX_SOURCE = 64 << 20
SOURCE = "source"


def _json_code(text: Column) -> Column:
    whole = (json_error(text, MAX_SOURCE) == "") & trim(present(text)).startswith("{")
    return F.when(whole, "").otherwise(JSON_INVALID)


def source_errors(documents: DataFrame, id_col: str = "task_id", content_col: str = "content", digest_col: str = "expected_sha256") -> DataFrame:
    """task_id and code of every document: the first thing that keeps its bytes from being
    assessed, or ''. The id must be canonical, there must be bytes and not too many, and they
    must be those of the digest that was kept, and a strict JSON object in UTF-8."""
    raw, digest = F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")), lower(trim(present(digest_col)))
    size = F.octet_length(raw)
    text = F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit(""))
    code = (
        F.when(~is_task_id(F.col(id_col)), ID_INVALID)
        .when((size == 0) | (size > MAX_SOURCE), SIZE_INVALID)
        .when(~digest.rlike(r"^[0-9a-f]{64}\z"), HASH_MISSING)
        .when(F.sha2(raw, 256) != digest, HASH_MISMATCH)
        .otherwise(_json_code(text))
    )
    return documents.select(F.col(id_col).alias("task_id"), code.alias("code"))


def audit(documents: DataFrame, id_col: str = "task_id", json_col: str = "json") -> DataFrame:
    """task_id, scope, component_id, field, requirement, status: the document's fields
    and, per component with the primary one first, its fields and two facts that
    documents don't state. A document that isn't a strict JSON object gives one row of
    scope source, whose field is the error's code."""
    judged = documents.select(F.col(id_col).alias("task_id"), F.col(json_col).alias("_json"), F.explode(F.array(_json_code(F.col(json_col)))).alias("_code"))
    parsed = F.when(F.col("_code") == "", F.from_json("_json", DOCUMENT)).alias("d")
    judged = saved(judged.select("task_id", "_code", parsed), "judged")  # for the document's rows, its components' and the refused
    failed = judged.where("_code <> ''").select(
        "task_id", F.lit(SOURCE).alias("scope"), F.lit("").alias("component_id"), F.col("_code").alias("field"), F.lit(MUST).alias("requirement"), F.lit(BLOCKED).alias("status")
    )
    d = judged.where("_code = ''").select("task_id", "d")
    listed = F.concat(
        F.when(F.col("d.metadata.component").isNotNull(), F.array("d.metadata.component")).otherwise(F.array().cast(f"array<{COMPONENT}>")),
        F.coalesce("d.components", F.array().cast(f"array<{COMPONENT}>")),
    )
    refs = F.transform(listed, lambda c: present(c["bom-ref"]))
    owners = F.coalesce(F.transform("d.dependencies", lambda x: present(x["ref"])), F.array().cast("array<string>"))
    claimed = _any(F.col("d.compositions"), lambda c: (c["aggregate"] == "complete") & c["assemblies"].isNull() & c["dependencies"].isNull())
    complete = claimed & (F.size(refs) > 0) & (F.size(F.array_except(refs, owners)) == 0) & ~F.array_contains(refs, "")
    rows = d.withColumns({"listed": listed, "owners": owners, "complete": complete})
    own = _unpivoted(rows, document_rules(F.col("d"), F.col("complete")), F.lit("document"), F.lit(""))
    each = rows.select("task_id", "owners", "complete", F.posexplode("listed").alias("n", "c"), F.col("d.metadata.component").isNotNull().alias("has_primary"))
    each = each.withColumn("component_id", F.format_string("component-%06d", F.col("n")))
    facts = [
        ("component.descriptionKind", MUST, _if(F.col("c.type") == "file")),
        ("component.descriptionLevel", MUST, F.lit(BLOCKED)),
    ]
    rules = component_rules(F.col("c"), F.col("complete"), F.array_contains("owners", present(F.col("c")["bom-ref"])))
    return own.unionByName(_unpivoted(each, facts + rules, F.lit("component"), F.col("component_id"))).unionByName(failed)


def _unpivoted(rows: DataFrame, rules: list[tuple[str, str, Column]], scope: Column, component: Column) -> DataFrame:
    built = [F.struct(F.lit(f).alias("field"), F.lit(r).alias("requirement"), s.alias("status")) for f, r, s in rules]
    return rows.select("task_id", scope.alias("scope"), component.alias("component_id"), F.inline(F.array(*built)))


def summary(fields: DataFrame) -> DataFrame:
    """Per assessed document: counts of each status and the verdict. The two facts beside
    the fields count as blockers only."""
    fields = fields.where(F.col("scope") != SOURCE)
    fact = F.col("field").isin("component.descriptionKind", "component.descriptionLevel")
    count = lambda s: F.count_if((F.col("status") == s) & ~fact).alias(s.replace("-", "_"))
    blocked = F.count_if(F.col("status") == BLOCKED)
    return fields.groupBy("task_id").agg(
        F.count_distinct(F.when(F.col("scope") == "component", F.col("component_id"))).alias("components_assessed"),
        *[count(s) for s in (MAPPED, DERIVABLE, UNSEEN)],
        blocked.alias("blocked"),
        F.when(blocked > 0, "blocked").otherwise("review-required").alias("verdict"),
    )


def blockers(fields: DataFrame) -> DataFrame:
    return fields.where((F.col("status") == BLOCKED) & (F.col("scope") != SOURCE)).select("task_id", "scope", "component_id", "field")


ADVISORIES = (
    "The assessment checks structure; it does not validate the document against a schema.",
    "The registered spelling of the effective-licence property is used.",
    "The guideline's version is pinned, and may not be the current one.",
)


def advisories(fields: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.lit(a) for a in ADVISORIES])).alias("text")
    return fields.where(F.col("scope") != SOURCE).select("task_id").distinct().select("task_id", rows)


