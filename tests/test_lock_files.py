"""Lock files take one pass that holds few of them at a time; what is left out of it for
speed changes no result."""

from __future__ import annotations

import contextlib
import io
import json
import re

from pyspark.sql import functions as F

from ledgerline.functions import purl, versions
from ledgerline.operators import parse, strict_json
from ledgerline.plans import strictness

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def locks(spark, texts):
    return spark.createDataFrame([(p, "package-lock-json", c) for p, c in texts.items()], "relative_path string, parser string, content string")


def test_wide_texts_are_made_behind_their_exchange(spark):
    wide = strictness._lock_files(spark, SF).where("relative_path like 'wide/%'")
    exchanges = re.split(r"Exchange hashpartitioning", plan(wide))
    assert len(exchanges) == 2 and "transform(" in exchanges[0] and "transform(" not in exchanges[1]
    assert strictness._lock_files(spark, SF).rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_no_column_of_texts_is_read_back(spark):
    rows = parse.components(locks(spark, {"a": "{}"}), ["package-lock-json"])
    text = plan(rows)
    assert "FileScan" not in text and text.count("MapInArrow") == 1 and text.count("from_json") == 1


def test_both_forms_share_a_pass(spark):
    old = lambda n: json.dumps({"dependencies": {f"d{n}": {"version": f"{n}.0.0", "integrity": 7, "dependencies": {"in": {}}}, "x": {"dependencies": {}}}})
    new = lambda n: json.dumps(
        {"packages": {"": {"name": f"app{n}", "version": "1.0.0"}, "node_modules/a": {"version": f"{n}.1.0"}, "q": None, "node_modules/@s/b/node_modules/@t/c": {"name": ""}}, "dependencies": {"no": {}}}
    )
    texts = {f"{k}{n}": made(n) for n in range(30) for k, made in (("old", old), ("new", new))}
    texts |= {"empty": '{"packages": {}, "dependencies": {"no": {}}}', "none": "{}", "bad": '{"packages": {', "list": "[]", "spaced": "\x00 \n" + old(1), "after": "\n " + old(9)}
    rows = parse.components(locks(spark, texts).coalesce(1), ["package-lock-json"]).orderBy("relative_path", "place").collect()
    got = {}
    for r in rows:
        got.setdefault(r["relative_path"], []).append((r["place"], r["name"], r["version"], r["dependency_scope"], r["component_type"], r["package_url"]))
    of_old = lambda n: [
        (0, f"d{n}", f"{n}.0.0", "resolved", "library", f"pkg:npm/d{n}@{n}.0.0"), (1, "in", "", "resolved", "library", ""), (2, "x", "", "resolved", "library", ""),
    ]
    of_new = lambda n: [
        (0, f"app{n}", "1.0.0", "project", "application", f"pkg:npm/app{n}@1.0.0"), (1, "a", f"{n}.1.0", "resolved", "library", f"pkg:npm/a@{n}.1.0"),
        (3, "@t/c", "", "resolved", "library", ""),
    ]
    assert got == {f"old{n}": of_old(n) for n in range(30)} | {f"new{n}": of_new(n) for n in range(30)} | {"after": of_old(9)}


def test_verdicts_that_no_longer_take_a_pass(spark):
    cases = [
        ('{"a":1,\x0b"b":2}', "syntax"), ("[1\x0c]", "syntax"), ("[1,\x0c2]", "syntax"), ("[é]", "syntax"), ("[1é]", "syntax"), ("[true\x852]", "syntax"), ("[#1]", "syntax"), ("[1_0]", "syntax"),
        ('{"a\x0bb":1}', "syntax"), ('{"a":"\x1f"}', "syntax"), ('{"a":"\x7f\x85é"}', ""), ('\n{"a":"b"}\n', ""), ('{"a":"\\\x01"}', "syntax"), ('{"a":"\\', "syntax"), ("\\", "syntax"), ('["\\"","\\\\"]', ""),
        (' \n\t\r', "empty"), ('" "', ""), ('["' + "\\\\" * 9 + '",1]', ""), ("[" + ",".join(["0"] * 262_144) + "]", "nodes"), ('["' + "x" * 1_100_000 + '"]', ""), (" " * 1_100_000 + "[]", ""),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r["i"]: r["e"] for r in df.select("i", strict_json.json_error(F.col("c")).alias("e")).collect()}
    assert [(c[:40], got[i]) for i, (c, _) in enumerate(cases)] == [(c[:40], w) for c, w in cases]


def test_plain_package_urls_equal_the_others(spark):
    names = {
        "abc": "abc", "a.b_c-d9": "a.b_c-d9", "9": "9", " abc\t": "abc", "ABC": "abc", "_x": "_x", "a~b": "a~b", "a b": "a%20b", "@s/p": "%40s/p", "@S/P+": "%40s/p%2B", "@s": None, "@s/": None,
        "@/p": None, "s/p": None, "@s/p/q": None, "a/": None, "/": None, "a@b": "a%40b", "é": "%C3%A9", "a%2Fb": "a%252fb", "@a%/b*": "%40a%25/b%2A", "a\n": "a", "": None,
    }
    found = {
        "1.2.3": "1.2.3", "01.2.3": "01.2.3", " 1.2.3\n": "1.2.3", "v1.2.3-b+c": "v1.2.3-b%2Bc", "1.2": None, "1.2.3.4": None, "1.2.x": None, "1.2.3+": None, "^1.2.3": None, "latest": None, "git+x": None, "": None,
    }
    rows = spark.createDataFrame([(n, v, f"pkg:npm/{p}@{q}" if p and q else "") for n, p in names.items() for v, q in found.items()], "n string, v string, want string")
    for ecosystem in (F.lit("npm"), F.when(F.rand() < 2, " NPM "), F.when(F.rand() < 2, "npm")):
        made = rows.select("n", "v", "want", purl.package_url(ecosystem, F.col("n"), F.col("v")).alias("got"))
        assert made.where("not got <=> want").collect() == []


def test_exact_versions_by_one_pattern(spark):
    found = {
        "1": True, "1.0-rc": True, "V2": True, "": False, " ": False, "x": False, "1.X": False, "1-x": False, "1.xy": True, "a+": False, "a+b": True, "Latest": False, "latest.1": False, "latest1": True,
        "nexts": True, "stable": False, "next\n": False, ">=1": False, "a b": False, "npm:a": False, "xnpm:a": True, "a/b": False, "git@h": False, "$a": False, "file:a": False, "1\u2028": True, "stable\u2028": True, None: None,
    }
    rows = spark.createDataFrame(list(found.items()), "v string, want boolean")
    assert rows.where(~versions.is_exact(F.col("v")).eqNullSafe(F.col("want"))).collect() == []
