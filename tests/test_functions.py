from pyspark.sql import functions as F

from ledgerline.functions import display, hashes, patterns, purl, spdx, text, versions


def column(spark, rows, expr, schema):
    df = spark.createDataFrame(rows, schema)
    return [r["v"] for r in df.coalesce(1).select(expr.alias("v")).collect()]


def test_package_urls(spark):
    cases = [
        ("npm", "@Scope/Name", "1.2.3", "pkg:npm/%40scope/name@1.2.3"), ("npm", "a", "1.2", ""), ("npm", "a/b", "1.0.0", ""), ("npm", "a", "v1.0.0", "pkg:npm/a@v1.0.0"),
        ("PyPI", "Foo.Bar__x", "1.0", "pkg:pypi/foo-bar-x@1.0"), ("PyPI", "-x", "1.0", ""), ("Gradle", "g:a", "1.0", "pkg:maven/g/a@1.0"), ("Gradle", "g", "1.0", ""),
        ("Go", "a.b/c", "v1.0.0", "pkg:golang/a.b/c@v1.0.0"), ("Swift", "a/b", "1.0", "pkg:swift/a/b@1.0"), ("NuGet", "a/b", "1.0", "pkg:nuget/a%2Fb@1.0"),
        ("vcpkg", "z lib", "1.0+x", "pkg:generic/z%20lib@1.0%2Bx"), ("Maven", "g:a", "1.0", ""), ("Cargo", "x", "^1", ""), ("Cargo", "é~*", "1", "pkg:cargo/%C3%A9~%2A@1"), ("npm", "", "1.0.0", ""),
    ]
    got = column(spark, [c[:3] for c in cases], purl.package_url(F.col("e"), F.col("n"), F.col("v")), "e string, n string, v string")
    assert got == [c[3] for c in cases]


def test_versions(spark):
    ranges = ["^1", "~1", ">=1", "1.x", "x", "1-x", "1 2", "1+", "[1,2)", "1|2", "*"]
    exact = ["1.0", "v1", "1.0.0-x1", "1.0+b", "xy", "01"]
    neither = ["", "latest", "Next", "latest.release", "git+https://x", "a/b", "1#2", "${v}", "npm:x@1", "workspace:*"]
    assert all(column(spark, [(v,) for v in ranges], versions.is_range(F.col("v")), "v string"))
    assert all(column(spark, [(v,) for v in exact], versions.is_exact(F.col("v")), "v string"))
    assert not any(column(spark, [(v,) for v in neither], versions.is_exact(F.col("v")) | versions.is_range(F.col("v")), "v string"))
    assert column(spark, [("1.2",), ("1",), ("1.2-a",), ("1.2.3",)], versions.is_range_in(F.lit("npm"), F.col("v")), "v string") == [True, True, False, False]
    assert column(spark, [("0.0",), ("1.0",), ("1",), ("1.2.3.4.5.6.7.8.9",)], versions.is_exact_binary(F.col("v")), "v string") == [False, True, False, False]


def test_identities_in_and_out_of_the_jvm_agree(spark):
    cases = {
        "pkg:npm/a@1": "purl:pkg:npm/a", "PKG:NPM//a@1": "purl:pkg:npm/a", "pkg:npm/%40s/a@1?b=2&a=%41#x/y": "purl:pkg:npm/%40s/a?a=A&b=2#x/y", "pkg:npm/a@": "",
        "pkg:npm/a@b@c": "", "pkg:npm/a?x": "", "pkg:npm/a?": "", "pkg:npm/a#.": "", "pkg:npm/a#x?y": "", "pkg:1npm/a": "", "pkg:npm/a%2Fb": "purl:pkg:npm/a%2Fb",
        "pkg:npm/a%2Fb/c": "", "pkg:npm/a%zz": "", "pkg:npm/é": "", "pkg:npm/%C3%A9": "purl:pkg:npm/%C3%A9", "pkg:npm/%C3": "", "x": "", "": "", "pkg:npm/a?a=1&a=2": "", "pkg:npm/a//b": "",
    }
    assert column(spark, [(c,) for c in cases], purl.strong_identity(F.col("p")), "p string") == list(cases.values())
    assert [purl.versionless_identity(c) for c in cases] == list(cases.values())


def test_ignore_rules(spark):
    rules = ["node_modules", "*.log", "build/out", "src/*.tmp", "# no", "", "./doc/"]
    cases = {
        "a/node_modules/b": True, "node_modules2/a": False, "x/y.log": True, "build/out": True, "a/build/out": False, "src/a/b.tmp": True, "doc/x": True, "./x.log": True, "ok": False,
    }
    assert column(spark, [(c,) for c in cases], patterns.ignores(F.col("p"), False, rules), "p string") == list(cases.values())
    assert column(spark, [("build/out",), ("build",)], patterns.ignores(F.col("p"), True, ["build/*"]), "p string") == [True, False]


def test_license_expressions(spark):
    good = ["MIT", "MIT OR Apache-2.0", "(MIT AND (ISC OR BSD-3-Clause)) OR GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0+", "DocumentRef-a:LicenseRef-b", "((MIT))"]
    good += ["( MIT )", "MIT  AND   ISC", " MIT ", "GPL-2.0-or-later+ OR LicenseRef-x", "(" * 32 + "MIT" + ")" * 32, "MIT" + " AND ISC" * 127]
    bad = ["(" * 33 + "MIT" + ")" * 33, "MIT" + " AND ISC" * 128, "MIT +", "LicenseRef-x+", "LicenseRef-x WITH LLVM-exception", "(MIT)AND ISC", "MIT AND(ISC)", "MIT\tAND ISC", "MIT\n", "MIT/ISC", "()", "x" * 5000][:-1] + ["", "mit", "MIT AND", "MIT and ISC", "(MIT", "MIT)", "MIT WITH MIT", "Nope", "MIT ISC", "(MIT) WITH Classpath-exception-2.0"]
    assert all(column(spark, [(x,) for x in good], spdx.is_valid_expression(F.col("x")), "x string"))
    assert not any(column(spark, [(x,) for x in bad], spdx.is_valid_expression(F.col("x")), "x string"))
    names = spark.createDataFrame([("MIT", False), ("New-1.0", False), ("Some-exception", True)], "name string, is_exception boolean")
    rows = spark.createDataFrame([("New-1.0 WITH Some-exception",), ("MIT OR New-1.0+",), ("ISC",), (None,), ("MIT OR New-1.0+",), ("MIT " * 5000,)], "x string")
    assert sorted((r["x"] or "", r["valid"]) for r in spdx.valid_expressions(rows, "x", names).collect())[:5] == [("", False), ("ISC", False), ("MIT " * 5000, False), ("MIT OR New-1.0+", True), ("MIT OR New-1.0+", True)]


def test_texts(spark):
    assert column(spark, [("\t a \n",)], text.trim(F.col("x")), "x string") == ["a"]
    assert column(spark, [("ÀB",)], text.lower(F.col("x")), "x string") == ["Àb"]
    assert column(spark, [("é",)], text.key_part(F.col("x")), "x string") == ["2:é"]
    assert column(spark, [(["MIT", "mit", "BSD"],)], text.distinct_folded(F.col("x")), "x array<string>") == [["BSD", "MIT"]]
    assert column(spark, [("\\a\\b\\",)], text.base_name(F.col("x")), "x string") == ["b"]
    assert column(spark, [(59_950,), (61_000,), (-5,)], display.duration_text(F.col("x")), "x long") == ["60.0 s", "1 min 1.0 s", "0.0 s"]
    assert column(spark, [(1023,), (1024,), (1536 * 1024,)], display.size_text(F.col("x")), "x long") == ["1023 B", "1.0 KiB", "1.5 MiB"]
    assert column(spark, [("2024-01-01T00:00:01Z", "2024-01-01T00:00:00Z"), ("bad", "x")], display.duration_ms(F.col("a"), F.col("b")), "a string, b string") == [1000, 0]
    assert column(spark, [("A" * 64,), ("x",)], hashes.canonical_sha256(F.col("x")), "x string") == ["a" * 64, ""]
