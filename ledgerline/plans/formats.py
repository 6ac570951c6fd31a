"""Manifests written from part, one per format, with the rows that each must give.

Files hold the parts of one brand and one range of keys, so they grow in number, not in
size. Lines and rows are templates with $K for the part's key, $S for its size and $H for
the SHA-256 of its name; parts of even and odd size have lines of their own. The same
templates give the files' columns in Spark and the expected rows in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse

#: Keys that one file covers at most.
KEYS_PER_FILE = 500

Row = tuple[str, str, str, str]


@dataclass(frozen=True)
class Format:
    """even and odd: (line, rows as name, version, scope and package URL). Rows of own are
    stated once per file. Where start is None, every line is a file of its own."""

    parser: str
    start: str | None
    even: tuple[str, list[Row]]
    odd: tuple[str, list[Row]] | None = None
    end: str = ""
    between: str = "\n"
    own: tuple[Row, ...] = ()


FORMATS: dict[str, Format] = {
    "parsed_requirements": Format(
        "requirements-text", "# made\n-r base.txt\n",
        ("Part_$K[extra] ===$S.0  # note", [("Part_$K", "$S.0", "runtime", "pkg:pypi/part-$K@$S.0")]),
        ("Part_$K>=$S.0 ; python_version > '3'", [("Part_$K", ">=$S.0", "runtime", "")]),
    ),
    "parsed_cargo_lock": Format(
        "conservative-cargo-lock", "version = 3\n\n",
        ('[[package]]\nname = "part-$K"\nversion = "1.$S.0"\nchecksum = "$H"\n', [("part-$K", "1.$S.0", "resolved", "pkg:cargo/part-$K@1.$S.0")]),
    ),
    "parsed_package_json": Format(
        "package-json", '{"name": "app", "version": "1.0.0", "devDependencies": {',
        ('"@s/part-$K": "^1.2.$S"', [("@s/part-$K", "^1.2.$S", "development", "")]),
        ('"@s/part-$K": "1.2.$S"', [("@s/part-$K", "1.2.$S", "development", "pkg:npm/%40s/part-$K@1.2.$S")]),
        "}}", ", ", (("app", "1.0.0", "project", "pkg:npm/app@1.0.0"),),
    ),
    "parsed_installed_package": Format(
        "installed-package-json", None,
        ('{"name": "left$K", "version": "1.$S.3-a.1"}', [("left$K", "1.$S.3-a.1", "resolved", "pkg:npm/left$K@1.$S.3-a.1")]),
        ('{"name": "-bad$K", "version": "1.$S"}', []),
    ),
    "parsed_dist_info": Format(
        "python-dist-info-metadata", None,
        ("Metadata-Version: 2.1\nName: Demo.Pkg$K\nVersion: 1.$S\nLicense: MIT\n\nName: body", [("Demo.Pkg$K", "1.$S", "resolved", "pkg:pypi/demo-pkg$K@1.$S")]),
        ("Name: Demo$K\r\nName: Demo$K\r\nVersion: 1.$S\r\n", []),
    ),
    "parsed_package_lock": Format(
        "package-lock-json", '{"packages": {"": {"name": "app", "version": "1.0.0"}, ',
        ('"node_modules/x/node_modules/@s/t$K": {"version": "1.$S.0"}', [("@s/t$K", "1.$S.0", "resolved", "pkg:npm/%40s/t$K@1.$S.0")]),
        ('"node_modules/y$K": {"name": "z$K", "version": "2.$S.0"}', [("z$K", "2.$S.0", "resolved", "pkg:npm/z$K@2.$S.0")]),
        "}}", ", ", (("app", "1.0.0", "project", "pkg:npm/app@1.0.0"),),
    ),
    "parsed_old_package_lock": Format(
        "package-lock-json", '{"dependencies": {',
        ('"a$K": {"version": "1.$S.0", "dependencies": {"b$K": {"version": "2.$S.0"}}}',
         [("a$K", "1.$S.0", "resolved", "pkg:npm/a$K@1.$S.0"), ("b$K", "2.$S.0", "resolved", "pkg:npm/b$K@2.$S.0")]),
        None, "}}", ", ",
    ),
    "parsed_go_mod": Format(
        "go-mod-text", "module m\nrequire direct.example/a v1.0.0\nrequire (\n",
        ("\texample.com/m$K v1.$S.0", [("example.com/m$K", "v1.$S.0", "runtime", "pkg:golang/example.com/m$K@v1.$S.0")]),
        ("  example.com/m$K  v1.$S.0 // indirect", [("example.com/m$K", "v1.$S.0", "indirect", "pkg:golang/example.com/m$K@v1.$S.0")]),
        "\n)\nexclude x v1", own=(("direct.example/a", "v1.0.0", "runtime", "pkg:golang/direct.example/a@v1.0.0"),),
    ),
    "parsed_go_sum": Format(
        "conservative-go-sum", "",
        ("example.com/m$K v1.$S.0 h1:x=\nexample.com/m$K v1.$S.0/go.mod h1:y=", [("example.com/m$K", "v1.$S.0", "resolved", "pkg:golang/example.com/m$K@v1.$S.0")] * 2),
    ),
    "parsed_maven_pom": Format(
        "maven-pom-xml", "<project><!-- <dependency><artifactId>no</artifactId></dependency> --><dependencies>",
        ("<dependency><groupId>org.g</groupId><artifactId>a$K</artifactId><version>1.$S</version></dependency>", [("a$K", "1.$S", "runtime", "pkg:maven/org.g/a$K@1.$S")]),
        ("<dependency><groupId>org.g</groupId><artifactId>a$K</artifactId><version>${v}</version><scope>test</scope></dependency>", [("a$K", "${v}", "development", "")]),
        "</dependencies></project>",
    ),
    "parsed_msbuild": Format(
        "msbuild-package-reference", "<Project><ItemGroup>",
        ('<PackageReference Include="A$K" Version="1.$S.0" />', [("A$K", "1.$S.0", "runtime", "pkg:nuget/A$K@1.$S.0")]),
        ('<PackageReference Update="A$K"><Version>[1.$S]</Version></PackageReference>', [("A$K", "[1.$S]", "runtime", "")]),
        "</ItemGroup></Project>",
    ),
    "parsed_central_packages": Format(
        "msbuild-central-package-xml", "<Project>",
        ('<PackageVersion Include="A$K" Version="1.$S" />', [("A$K", "1.$S", "runtime", "pkg:nuget/A$K@1.$S")]), None, "</Project>",
    ),
    "parsed_nuget_lock": Format(
        "nuget-lock-json", '{"dependencies": {"net8.0": {',
        ('"A$K": {"type": "Direct", "resolved": "1.$S.0", "requested": "[1.$S.0, )"}', [("A$K", "1.$S.0", "direct", "pkg:nuget/A$K@1.$S.0")]),
        ('"A$K": {"requested": "[1.$S.0, )"}', [("A$K", "[1.$S.0, )", "resolved", "")]), "}}}", ", ",
    ),
    "parsed_composer_json": Format(
        "composer-json", '{"name": "v/app", "license": ["MIT"], "require-dev": {',
        ('"v/p$K": "1.$S.0"', [("v/p$K", "1.$S.0", "development", "pkg:composer/v/p$K@1.$S.0")]),
        ('"v/p$K": "^1.$S"', [("v/p$K", "^1.$S", "development", "")]), "}}", ", ", (("v/app", "", "project", ""),),
    ),
    "parsed_composer_lock": Format(
        "composer-lock-json", '{"packages-dev": [{"name": "t/t", "version": "9.0"}], "packages": [',
        ('{"name": "v/p$K", "version": "1.$S.0", "license": ["MIT", "L-$S"], "authors": [{"name": "Ann $K"}]}', [("v/p$K", "1.$S.0", "runtime", "pkg:composer/v/p$K@1.$S.0")]),
        None, "]}", ", ", (("t/t", "9.0", "development", "pkg:composer/t/t@9.0"),),
    ),
    "parsed_lazarus": Format(
        "lazarus-project-xml", '<CONFIG><ProjectOptions><RequiredPackages Count="1">',
        ('<Item$K><PackageName Value="P$K"/></Item$K>', [("P$K", "", "build", "")]),
        ("<Item$K><PackageName>P$K</PackageName></Item$K>", [("P$K", "", "build", "")]),
        '</RequiredPackages><Units><Item2><PackageName Value="no"/></Item2></Units></ProjectOptions></CONFIG>',
    ),
    "parsed_pipfile_lock": Format(
        "pipfile-lock-json", '{"develop": {"t": {"version": "==2.0"}}, "default": {',
        ('"p$K": {"version": "==1.$S"}', [("p$K", "1.$S", "runtime", "pkg:pypi/p$K@1.$S")]),
        ('"p$K": "*"', [("p$K", "*", "runtime", "")]), "}}", ", ", (("t", "2.0", "development", "pkg:pypi/t@2.0"),),
    ),
    "parsed_cargo_toml": Format(
        "conservative-cargo-toml", '[package]\nname = "app"\nversion = "0.1.0"\n[dev-dependencies]\nt = "2"\n[dependencies]\n',
        ('c$K = "1.$S"', [("c$K", "1.$S", "runtime", "")]), ('c$K = { version = "1.$S", features = ["x"] }', [("c$K", "1.$S", "runtime", "")]),
        own=(("app", "0.1.0", "project", "pkg:cargo/app@0.1.0"), ("t", "2", "development", "")),
    ),
    "parsed_poetry_lock": Format(
        "conservative-poetry-lock", "",
        ('[[package]]\nname = "p$K"\nversion = "1.$S"\nfiles = [\n    {file = "p.whl", hash = "sha256:$H"},\n]\n\n[package.dependencies]\nname = "no"\n', [("p$K", "1.$S", "resolved", "pkg:pypi/p$K@1.$S")]),
    ),
    "parsed_pyproject": Format(
        "conservative-pyproject-toml", None,
        ('[tool.poetry]\nname = "no"\n[project]\nname = "Demo.$K"\nversion = "1.$S"\n', [("Demo.$K", "1.$S", "project", "pkg:pypi/demo-$K@1.$S")]),
        ('[tool.poetry]\nname = "demo$K"\nversion = "1.$S"\n', [("demo$K", "1.$S", "project", "pkg:pypi/demo$K@1.$S")]),
    ),
    "parsed_yarn_lock": Format(
        "conservative-yarn-lock", "# yarn lockfile v1\n\n",
        ('"@s/a$K@^1.0.0", "@s/a$K@^1.1.0":\n  version "1.$S.0"\n  resolved "x"\n', [("@s/a$K", "1.$S.0", "resolved", "pkg:npm/%40s/a$K@1.$S.0")]),
        ('b$K@~2:\n  version "2.$S.1"\n', [("b$K", "2.$S.1", "resolved", "pkg:npm/b$K@2.$S.1")]),
    ),
    "parsed_pnpm_lock": Format(
        "conservative-pnpm-lock", "packages:\n",
        ("  /a$K/1.$S.0:", [("a$K", "1.$S.0", "resolved", "pkg:npm/a$K@1.$S.0")]),
        ("  /@s/b$K/2.$S.0(react@1):", [("@s/b$K", "2.$S.0", "resolved", "pkg:npm/%40s/b$K@2.$S.0")]), "\n  x: y",
    ),
    "parsed_gradle_lock": Format(
        "conservative-gradle-lock", "# c\n", ("org.g:a$K:1.$S=compileClasspath", [("org.g:a$K", "1.$S", "resolved", "pkg:maven/org.g/a$K@1.$S")]), None, "\nempty=x",
    ),
    "parsed_gemfile_lock": Format(
        "conservative-gemfile-lock", "GEM\n  specs:\n", ("    gem$K (1.$S)\n      dep (>= 1.0)", [("gem$K", "1.$S", "resolved", "pkg:gem/gem$K@1.$S")]), None, "\n\nPLATFORMS\n    no (1)",
    ),
    "parsed_conda": Format(
        "conservative-conda-yaml", "name: x\ndependencies:\n",
        ("  - c$K=1.$S=py1", [("c$K", "1.$S", "runtime", "pkg:conda/c$K@1.$S")]), ("  - c$K", [("c$K", "", "runtime", "")]), "\n  - pip:\nother:\n  - no=1",
    ),
    "parsed_swift": Format(
        "conservative-swift-resolved-json", '{"pins": [',
        ('{"identity": "s$K", "state": {"version": "1.$S.0"}}', [("s$K", "1.$S.0", "resolved", "pkg:swift/s$K@1.$S.0")]),
        ('{"package": "S$K", "state": {"revision": "abc$S"}}', [("S$K", "abc$S", "resolved", "pkg:swift/S$K@abc$S")]), "]}", ", ",
    ),
    "parsed_podfile_lock": Format(
        "conservative-podfile-lock", "PODS:\n",
        ("  - P$K/Core (1.$S):\n    - Q (2.0)", [("P$K", "1.$S", "resolved", "pkg:cocoapods/P$K@1.$S")]),
        ("  - P$K (1.$S)", [("P$K", "1.$S", "resolved", "pkg:cocoapods/P$K@1.$S")]), "\nX:\n  - D (1)",
    ),
    "parsed_vcpkg": Format(
        "conservative-vcpkg-json", '{"dependencies": [',
        ('"z$K"', [("z$K", "", "runtime", "")]), ('{"name": "z$K", "version>=": "1.$S.0"}', [("z$K", "1.$S.0", "runtime", "pkg:generic/z$K@1.$S.0")]), "]}", ", ",
    ),
    "parsed_conan": Format(
        "conservative-conan-text", "[requires]\n", ("z$K/1.$S@user/ch", [("z$K", "1.$S", "runtime", "pkg:conan/z$K@1.$S")]), None, "\n# c\n[options]\na/b",
    ),
}

MARKS = re.compile(r"(\$[KSHN])")


def _column(template: str) -> Column:
    of = {"$K": F.col("p_partkey").cast("string"), "$S": F.col("p_size").cast("string"), "$H": F.sha2("p_name", 256)}
    return F.concat(F.lit(""), *[of[x] if x in of else F.lit(x) for x in MARKS.split(template) if x])


def _sql(template: str) -> str:
    of = {"$K": "CAST(p_partkey AS VARCHAR)", "$S": "CAST(p_size AS VARCHAR)", "$H": "sha256(p_name)"}
    return " || ".join(["''", *[of.get(x) or "'" + x.replace("'", "''") + "'" for x in MARKS.split(template) if x]])


SQL_FOLDER = f"p_brand || '/' || CAST(p_partkey // {KEYS_PER_FILE} AS VARCHAR) || '/manifest'"
SQL_ONE = "'part/' || CAST(p_partkey AS VARCHAR) || '/manifest'"


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """relative_path, parser, content of the format's files."""
    form = FORMATS[name]
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_brand", "p_name")
    line = _column(form.even[0])
    if form.odd:
        line = F.when(F.col("p_size") % 2 == 0, line).otherwise(_column(form.odd[0]))
    if form.start is None:
        return part.select(F.concat(F.lit("part/"), "p_partkey", F.lit("/manifest")).alias("relative_path"), F.lit(form.parser).alias("parser"), line.alias("content"))
    number = F.floor(F.col("p_partkey") / KEYS_PER_FILE).cast("string")
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).getField("line")
    grouped = part.groupBy(F.concat("p_brand", F.lit("/"), number, F.lit("/manifest")).alias("relative_path"))
    content = F.concat(F.lit(form.start), F.array_join(listed, form.between), F.lit(form.end))
    return grouped.agg(content.alias("content")).select("relative_path", F.lit(form.parser).alias("parser"), "content")


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parse.components(files(spark, sf_dir, name), [FORMATS[name].parser])
        return rows.select("relative_path", "name", "version", "dependency_scope", "package_url")

    return run


def oracle(name: str) -> str:
    form = FORMATS[name]
    path = SQL_ONE if form.start is None else SQL_FOLDER
    names = ("name", "version", "dependency_scope", "package_url")

    def select(row: Row, rest: str) -> str:
        return f"SELECT {path} AS relative_path, {', '.join(f'{_sql(v)} AS {n}' for v, n in zip(row, names, strict=True))} FROM part{rest}"

    cases = [(form.even[1], "")] if form.odd is None else [(form.even[1], " WHERE p_size % 2 = 0"), (form.odd[1], " WHERE p_size % 2 = 1")]
    parts = [select(row, rest) for rows, rest in cases for row in rows]
    parts += [select(row, "").replace("SELECT ", "SELECT DISTINCT ", 1) for row in form.own]
    return "\nUNION ALL ".join(parts)


def declared_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that lock files declare for their packages."""
    found = [parse.components(files(spark, sf_dir, n), [FORMATS[n].parser]) for n in ("parsed_cargo_lock", "parsed_poetry_lock")]
    each = found[0].unionByName(found[1]).select("source_parser", "name", F.explode("hashes").alias("h"))
    return each.select("source_parser", "name", "h.algorithm", "h.digest", "h.subject")


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses and publishers that packages declare."""
    found = parse.components(files(spark, sf_dir, "parsed_composer_lock"), ["composer-lock-json"])
    return found.select("relative_path", "name", F.array_join("declared_licenses", ";").alias("licenses"), F.array_join("declared_publishers", ";").alias("publishers"))


def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each file of a strict, a partial and a whole format; some are malformed."""
    out = []
    for name in ("parsed_installed_package", "parsed_pyproject", "parsed_cargo_lock", "parsed_vcpkg"):
        own = files(spark, sf_dir, name)
        if name == "parsed_vcpkg":  # a quarter of the files lacks its end
            cut = F.expr("cast(split(relative_path, '/')[1] as int) % 4 = 1")
            own = own.withColumn("content", F.when(cut, F.expr("left(content, length(content) - 2)")).otherwise(F.col("content")))
        found = parse.outcomes(own, parse.components(own, [FORMATS[name].parser]))
        out.append(found.select(F.lit(name).alias("format"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


BAD, MORE = "The file is malformed.", "The format may hold more dependency evidence."
QUERIES = {n: query(n) for n in FORMATS} | {f.__name__: f for f in (declared_hashes, declarations, parse_outcomes)}
ORACLES = {n: oracle(n) for n in FORMATS} | {
    "declared_hashes": """SELECT 'conservative-cargo-lock' AS source_parser, 'part-' || p_partkey AS name, 'SHA-256' AS algorithm, sha256(p_name) AS digest, 'part-' || p_partkey || '@1.' || p_size || '.0' AS subject FROM part
UNION ALL SELECT 'conservative-poetry-lock', 'p' || p_partkey, 'SHA-256', sha256(p_name), 'p.whl' FROM part""",
    "declarations": f"SELECT DISTINCT 't/t' AS name, '' AS licenses, '' AS publishers, {SQL_FOLDER} AS relative_path FROM part UNION ALL SELECT 'v/p' || p_partkey AS name, 'MIT;L-' || p_size AS licenses, 'Ann ' || p_partkey AS publishers, {SQL_FOLDER} FROM part",
    "parse_outcomes": f"""WITH f AS (SELECT {SQL_FOLDER} AS relative_path, p_partkey // {KEYS_PER_FILE} AS number, count(*) AS n FROM part GROUP BY 1, 2)
SELECT 'parsed_installed_package' AS format, {SQL_ONE} AS relative_path, CASE WHEN p_size % 2 = 0 THEN 'parsed' ELSE 'failed' END AS status,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE '{BAD}' END AS message, CAST(1 - p_size % 2 AS INTEGER) AS component_count FROM part
UNION ALL SELECT 'parsed_pyproject', {SQL_ONE}, 'partially parsed', '{MORE}', 1 FROM part
UNION ALL SELECT 'parsed_cargo_lock', relative_path, 'partially parsed', '{MORE}', CAST(n AS INTEGER) FROM f
UNION ALL SELECT 'parsed_vcpkg', relative_path, CASE WHEN number % 4 = 1 THEN 'failed' ELSE 'partially parsed' END, CASE WHEN number % 4 = 1 THEN '{BAD}' ELSE '{MORE}' END, CASE WHEN number % 4 = 1 THEN 0 ELSE CAST(n AS INTEGER) END FROM f""",
}
