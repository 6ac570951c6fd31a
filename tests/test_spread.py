"""Small tables whose rows are much work are dealt to all tasks, and read once."""

from __future__ import annotations

import contextlib
import hashlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.functions.text import has_token
from ledgerline.operators import document, graph, parse, readiness, strict_json
from ledgerline.plans import images, queries, strictness, surface
from ledgerline.shared import spread
from ledgerline.sources import binaries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_documents_are_dealt_and_judged_once(spark):
    docs = surface._documents(spark, SF)
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "from_json" not in plan(readiness.audit(docs))


def test_documents_are_judged_where_they_are_dealt(spark):
    files = strictness._lock_files(spark, SF).where("relative_path like 'chain/%'")
    assert "regexp" not in plan(parse._json(files, "dependencies string")).split("RoundRobinPartitioning")[1]


def test_trees_of_several_files_share_a_batch():
    files = pa.RecordBatch.from_pydict({"relative_path": [f"f{k}" for k in range(100)], "tree": ['{"a": {"version": "1", "dependencies": {"b": {}}}}'] * 100})
    found = list(parse._walk(iter([files])))
    assert len(found) == 1 and found[0].to_pylist()[:3:2] == [
        {"relative_path": f"f{k}", "place": 0, "name": "a", "version": "1", "integrity": ""} for k in (0, 1)
    ]


def test_wide_documents_have_few_brackets(spark):
    texts = ["[" + "{}," * 999 + "{}]", "{}{}", "[]", "[" * 127 + "{}" + "]" * 127, "[" * 128 + "{}" + "]" * 128, "[[]{}", "[{]}", "[[{}],{},{},{},[]]", "{}]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = rows.select(strict_json.json_error(F.col("t")), F.size(strict_json._brackets(F.col("t")))).orderBy("n").collect()
    assert [r[0] for r in got] == ["", "syntax", "", "", "depth", "syntax", "syntax", "", "syntax"]
    assert got[0][1] == 4


def test_binaries_are_dealt_and_inspected_once(spark):
    files = images._pe_files(spark, SF)
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan(binaries.binary_components(files)).count("ArrowEvalPython") == 1


def test_small_tables_are_dealt(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert spread(part).count() == part.count()
    assert spread(part).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_artifacts_need_no_components(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(document, "dependency_edges", never)
    assert surface.document_artifacts(spark, SF).count() == spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_components_are_merged_once(spark):
    assert "l_orderkey" not in plan(queries.component_lines(spark, SF))


def test_references_are_written_as_bytes(spark, monkeypatch):
    urn = "urn:ledgerline:component:"
    refs = [urn + "0a" * 16, urn + "0A" * 16, urn + "0a", urn, "pkg:npm/é@1", "", urn + "zz" * 16, urn + "0a" * 17]
    rows = spark.createDataFrame([(r,) for r in refs], "r string").withColumn("p", graph.packed(F.col("r")))
    got = rows.select(graph.unpacked(F.col("p")), "p").collect()
    assert [r[0] for r in got] == refs and len(got[0][1]) == 17 and len({bytes(r[1]) for r in got}) == len(refs)
    kinds = []
    monkeypatch.setattr(graph, "saved", lambda df, name: kinds.extend(t for c, t in df.dtypes if c.endswith("ref")) or df)
    queries.dependency_edges(spark, SF)
    assert kinds and set(kinds) == {"binary"}


def test_no_list_of_dependencies_is_held(spark):
    edges = spark.createDataFrame([("a", "y"), ("b", None), ("a", "x"), ("a", "é"), ("a", "x"), ("", "z")], "owner_ref string, dep_ref string")
    got = {r["owner_ref"]: (r["n"], r["digest"]) for r in graph.dependency_digests(edges).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"a": (3, sha("x,y,é")), "b": (0, sha("")), "": (1, sha("z"))}
    assert graph.dependency_digests(edges.limit(0)).count() == 0
    assert "collect_" not in plan(queries.dependency_sets(spark, SF))


def test_tokens_are_looked_for_without_lists(spark):
    texts = ["runtime", "a, RunTime\t", "\nruntime\n,b", "runtimes", "a runtime", "", ",", None, "runtime b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(has_token(F.col("t"), "runtime")).collect()] == [True, True, True, False, False, False, False, None, False]
    assert "lambda" not in plan(rows.select(has_token(F.col("t"), "runtime")))


def test_members_are_told_apart_without_a_sort(spark):
    below = plan(queries.normalized(spark, SF)).split("posexplode")[1]
    first = [line for line in below.split("\n") if "Aggregate" in line][0]
    assert "HashAggregate" in first and "ObjectHash" not in first and "lambda" not in below.split("Exchange", 1)[1]


def test_comparison_reads_no_lists(spark):
    text = plan(queries._compared(spark, SF))
    assert "l_orderkey" in text and "manifest.json" in text and "evidence_paths" not in text and "declared_licenses" not in text
