import json
import os

from ledgerline.operators import advisories, cache, compare, document, graph, normalize, readiness, views
from ledgerline.schemas import COMPONENT


def component(name, version="1.0", purl="", ordinal=0, side="baseline", **more):
    row = dict.fromkeys([c.split()[0] for c in COMPONENT.split("evidence_paths")[0].strip(", ").split(", ")], "")
    row |= {"component_type": "library", "ecosystem": "npm", "name": name, "version": version, "package_url": purl, "source_artifact": "a", "source_parser": "package-json", "dependency_scope": "runtime"}
    row |= {"evidence_paths": ["a"], "declared_licenses": [], "declared_publishers": [], "declared_hashes": [], "side": side, "ordinal": ordinal, "first_ordinal": ordinal}
    return row | more


def frame(spark, rows):
    return spark.createDataFrame(rows, COMPONENT + ", side string, ordinal long, first_ordinal long")


def test_merging(spark):
    rows = [
        component("A", purl="pkg:npm/a@1", ordinal=2, declared_licenses=["MIT"], dependency_scope="runtime, Peer", source_artifact="z", company_name="", evidence_paths=["z"]),
        component("a", purl="pkg:npm/a@1", ordinal=1, declared_licenses=["mit", "BSD"], dependency_scope="peer", source_artifact="b", company_name="X", evidence_paths=["b", "Z"]),
        component("F", "1.0", ordinal=3), component("f", "1.0", ordinal=4), component("f", "1.0A", ordinal=5),
    ]
    got = {r["first_ordinal"]: r for r in normalize.normalize(frame(spark, rows)).collect()}
    assert set(got) == {1, 3, 5}
    one = got[1]
    assert (one["name"], one["source_artifact"], one["company_name"]) == ("a", "b", "X")
    assert one["dependency_scope"] == "peer, runtime" and one["declared_licenses"] == ["BSD", "mit"] and one["evidence_paths"] == ["Z", "b", "z"]
    many = [component("h", ordinal=i, declared_hashes=[{"algorithm": "SHA-256", "digest": f"{i:064d}", "subject": "", "source_artifact": "a", "source_parser": "p"}] * 2) for i in range(300)]
    found = normalize.normalize(frame(spark, many)).first()["declared_hashes"]
    assert len(found) == 256 and found[0]["digest"] == f"{0:064d}" and found[-1]["digest"] == f"{255:064d}"


def test_merging_without_lists(spark):
    rows = [component("A", purl=" pkg:npm/a@1", ordinal=2, dependency_scope=", runtime,Peer"), component("a", purl="pkg:npm/a@1\n", ordinal=1, dependency_scope="peer"), component("b\t", ordinal=4, dependency_scope=None), component("B", ordinal=3)]
    whole = normalize.normalize(frame(spark, rows), ["side"])
    few = normalize.normalize(frame(spark, rows), ["side"], lists=False)
    assert set(whole.columns) - set(few.columns) == {"evidence_paths", "declared_licenses", "declared_publishers", "declared_hashes"}
    got = sorted(few.collect())
    assert got == sorted(whole.select(few.columns).collect()) and [(r["first_ordinal"], r["name"], r["dependency_scope"]) for r in got] == [(3, "B", "runtime"), (1, "a", "peer, runtime")]


def kinds(spark, rows):
    return sorted((r["kind"], r["name"], r["before_version"], r["after_version"]) for r in compare.compare(frame(spark, rows)).collect())


def test_comparison(spark):
    b, a = (lambda *x, **k: component(*x, side="baseline", **k)), (lambda *x, **k: component(*x, side="current", **k))
    rows = [
        b("gone", purl="pkg:npm/gone@1"), a("new", "^1"), b("up", "1", purl="pkg:npm/up@1"), a("up", "2", purl="pkg:npm/up@2"), b("same"), a("same"),
        b("multi", "1"), b("multi", "2"), a("multi", "2"), a("multi", "3"), b("weak", "1", purl="pkg:npm/weak@1"), a("weak", "2"), b("Case"), a("case"), b("blank", ""), a("blank", "1"),
    ]
    want = [
        ("added", "case", "", "1.0"), ("added", "multi", "", "3"), ("added", "new", "", "^1"), ("removed", "Case", "1.0", ""), ("removed", "gone", "1.0", ""),
        ("removed", "multi", "1", ""), ("version_changed", "blank", "", "1"), ("version_changed", "up", "1", "2"), ("version_changed", "weak", "1", "2"),
    ]
    assert kinds(spark, rows) == sorted(want)
    swapped = [r | {"side": {"baseline": "current", "current": "baseline"}[r["side"]]} for r in reversed(rows)]
    turned = {"added": "removed", "removed": "added", "version_changed": "version_changed"}
    assert kinds(spark, swapped) == sorted((turned[k], n, y, x) for k, n, x, y in want)
    counts = compare.counters(frame(spark, rows)).first()
    assert (counts["added"], counts["removed"], counts["version_changed"], counts["unchanged"]) == (3, 3, 3, 2)


def test_ambiguous_fallbacks_stay_apart(spark):
    rows = [component("x", "1", "pkg:npm/a/x@1"), component("x", "1", "pkg:npm/b/x@1"), component("x", "2", side="current")]
    assert [k for k, *_ in kinds(spark, rows)] == ["added", "removed", "removed"]
    assert {r["kind"] for r in compare.warnings(frame(spark, rows)).collect()} == {"ambiguous"}


def test_graph_and_document(spark, tmp_path):
    rows = [
        component("tool", "1", ordinal=1, source_artifact="bin/tool", source_parser="binary-header", dependency_scope="", ecosystem="native", evidence_paths=["bin/tool"]),
        component("libz.so.1", "1", ordinal=2, source_artifact="bin/tool", source_parser="binary-dependency-table", ecosystem="native", evidence_paths=["bin/tool"]),
        component("app", "1.0.0", "pkg:npm/app@1.0.0", ordinal=3, dependency_scope="project", component_type="application", declared_licenses=["MIT"]),
        component("dep", "2.0.0", "pkg:npm/dep@2.0.0", ordinal=4, declared_licenses=["MIT OR ISC"]), component("any", "^1", ordinal=5),
    ]
    components = frame(spark, rows)
    artifacts = spark.createDataFrame([("bin/tool", "binary-header", "binary", "parsed"), ("a", "package-json", "package.json", "parsed")], "relative_path string, parser string, artifact_type string, status string")
    assert graph.sole_project(components).first()["name"] == "app"
    task = document.Task(id="0" * 8, target_directory="/x/demo/", timestamp="2024-01-01T00:00:00.000Z", author_email="a@b.c")
    text = document.render(document.document_rows(task, components.repartition(5), artifacts))
    assert text == document.render(document.document_rows(task, components.coalesce(1), artifacts)) and text.endswith("}\n")
    for k, (own, listed) in enumerate(((components.repartition(3), artifacts), (components.limit(0), artifacts), (components, artifacts.limit(0)), (components.limit(0), artifacts.limit(0)))):
        whole = document.render(document.document_rows(task, own, listed))
        lines = document.document_lines(task, own, listed)
        parts = document.write_lines(lines, f"file://{tmp_path}/lines {k}")
        assert document.assemble(parts, str(tmp_path / f"out{k}.json")) == len(whole.encode())
        assert (tmp_path / f"out{k}.json").read_text() == whole
    assert len(os.listdir(tmp_path)) == 8
    doc = json.loads(text)
    assert doc["metadata"]["component"]["name"] == "demo" and doc["metadata"]["component"]["bom-ref"] == "pkg:npm/app@1.0.0"
    by = {c["name"]: c for c in doc["components"]}
    assert set(by) == {"tool", "libz.so.1", "dep", "any"} and by["dep"]["licenses"] == [{"expression": "MIT OR ISC", "acknowledgement": "declared"}]
    assert "version" not in by["any"] and {"name": "ledgerline:requested-range", "value": "^1"} in by["any"]["properties"] and "version" not in by["libz.so.1"]
    deps = {d["ref"]: d["dependsOn"] for d in doc["dependencies"]}
    assert doc["dependencies"][0]["ref"] == "pkg:npm/app@1.0.0" and deps["pkg:npm/app@1.0.0"] == sorted(["pkg:npm/dep@2.0.0", by["any"]["bom-ref"]])
    assert deps[by["tool"]["bom-ref"]] == [by["libz.so.1"]["bom-ref"]]
    fields = readiness.audit(spark.createDataFrame([("t", text), ("bad", "{")], "task_id string, json string")).cache()
    status = {(r["component_id"], r["field"]): r["status"] for r in fields.collect()}
    assert status["", "sbom.format"] == "mapped" and status["", "sbom.buildEquivalence"] == "blocked" and status["component-000000", "component.name"] == "mapped"
    verdict = readiness.summary(fields).collect()
    assert len(verdict) == 1 and verdict[0]["verdict"] == "blocked" and verdict[0]["components_assessed"] == 5


def test_readiness_of_a_full_component(spark):
    prop = lambda n, v: {"name": f"bsi:component:{n}", "value": v}
    sha = [{"alg": "SHA-512", "content": "a" * 128}]
    full = {
        "type": "file", "bom-ref": "r", "name": "n", "version": "1", "purl": "pkg:npm/n@1", "manufacturer": {"contact": [{"email": "a@b.c"}]},
        "licenses": [{"expression": "MIT", "acknowledgement": "concluded"}, {"expression": "MIT", "acknowledgement": "declared"}],
        "properties": [prop("filename", "n.bin"), prop("executable", "executable"), prop("archive", "no archive"), prop("structured", "structured"), prop("effectiveLicence", "MIT")],
        "externalReferences": [{"type": t, "url": "https://x/y", "hashes": sha} for t in ("distribution", "source-distribution", "rfc-9116", "bom")],
    }
    doc = {"bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": "urn:uuid:1", "metadata": {"timestamp": "2024-01-01T00:00:00Z", "component": full, "authors": [{"email": "a@b.c"}]}}
    doc |= {"dependencies": [{"ref": "r"}], "compositions": [{"aggregate": "complete"}]}
    rows = readiness.audit(spark.createDataFrame([("t", json.dumps(doc))], "task_id string, json string")).collect()
    status = {r["field"]: r["status"] for r in rows}
    assert {f for f, s in status.items() if s != "mapped"} == {"component.descriptionLevel", "sbom.creator", "sbom.buildEquivalence"} and status["sbom.creator"] == "derivable"
    doc["vulnerabilities"] = []
    full["properties"].append(prop("filename", "other"))
    status = {r["field"]: r["status"] for r in readiness.audit(spark.createDataFrame([("t", json.dumps(doc))], "task_id string, json string")).collect()}
    assert status["component.filename"] == status["sbom.vulnerabilityInformation"] == "blocked"


def test_advisories(spark):
    rows = spark.createDataFrame([("pkg:npm/a@1",), ("pkg:NPM/a@1",), ("pkg:npm/b@1",), ("bad",), (None,)], "package_url string")
    known = spark.createDataFrame([("pkg:npm/a@1", "X", "2024"), ("pkg:npm/a@1", "X", "2025"), ("pkg:npm/c@1", "Y", "2024")], "package_url string, advisory_id string, modified string")
    assert [tuple(r) for r in advisories.matches(rows, known).collect()] == [("pkg:npm/a@1", "X", "2025")]
    assert tuple(advisories.candidate_counts(rows).first()) == (2, 1, 2)
    assert advisories.batches(rows).count() == 2


def test_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    context = cache.context_hash("/r", "1:2", ["b", "a", "a"], follow=False)
    assert context == cache.context_hash("/r", "1:2", ["a", "b"], follow=False) != cache.context_hash("/r", "1:2", ["a", "b"], follow=True)
    assert cache.load(spark, folder) is None
    entries = spark.createDataFrame([("a", "i", "h", "E")], "relative_path string, identity string, content_sha256 string, evidence string")
    cache.commit(spark, entries, folder, context)
    files = spark.createDataFrame([("a", "i", "h"), ("b", "i", "h"), ("a", "i", "other")], "relative_path string, identity string, content_sha256 string")
    hits, misses = cache.split(files, cache.load(spark, folder), context)
    assert hits.count() == 1 and misses.count() == 2
    assert cache.split(files, cache.load(spark, folder), "other")[0].count() == 0 == cache.split(files, cache.load(spark, folder), context, refresh=True)[0].count()


def test_lines_for_tables(spark):
    rows = spark.createDataFrame(
        [("a/go.mod", "Go module", "partially parsed", "", 2048, "Go", "ab"), ("b", None, "failed", "bad", None, "", "")],
        "relative_path string, artifact_type string, status string, message string, file_size long, ecosystem string, sha256 string",
    )
    lines = {r["relative_path"]: r["line"] for r in views.artifact_lines(rows).collect()}
    assert lines == {"a/go.mod": "a/go.mod\tGo module\t\u26a0 partial\t\t2.0 KiB\tGo\tab", "b": "b\t\t\u2715 failed\tbad\t0 B\t\t"}
