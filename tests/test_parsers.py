"""Each format on a small file, against the rows that it must give."""

import base64
import hashlib

import pytest

from ledgerline.operators import parse

SHA1 = base64.b64encode(hashlib.sha1(b"x").digest()).decode()
SHA512 = base64.b64encode(hashlib.sha512(b"x").digest()).decode()
HEX = "ab" * 32

#: parser -> (content, rows of (name, version, scope, package URL))
CASES = {
    "requirements-text": (
        "# c\nrequests==2.31.0  # pin\nflask>=2.2\nuvicorn[standard]===0.23.2 ; python_version > '3'\n-r x\nlib @ https://a/b\nname\n a~=1",
        [
            ("requests", "2.31.0", "runtime", "pkg:pypi/requests@2.31.0"), ("flask", ">=2.2", "runtime", ""),
            ("uvicorn", "0.23.2", "runtime", "pkg:pypi/uvicorn@0.23.2"), ("lib", "", "runtime", ""), ("name", "", "runtime", ""), ("a", "~=1", "runtime", ""),
        ],
    ),
    "package-json": (
        '{"name": "app", "version": "1.0.0", "license": "MIT", "author": {"name": "Ann", "email": "a@b"},'
        ' "dependencies": {"@s/a": "1.2.3", "b": "^2"}, "devDependencies": {"c": "1.0.0"}, "peerDependencies": {"d": {"x": 1}}}',
        [
            ("app", "1.0.0", "project", "pkg:npm/app@1.0.0"), ("@s/a", "1.2.3", "runtime", "pkg:npm/%40s/a@1.2.3"), ("b", "^2", "runtime", ""),
            ("c", "1.0.0", "development", "pkg:npm/c@1.0.0"), ("d", "", "peer", ""),
        ],
    ),
    "installed-package-json": ('{"name": "left", "version": "1.2.3-a.1"}', [("left", "1.2.3-a.1", "resolved", "pkg:npm/left@1.2.3-a.1")]),
    "python-dist-info-metadata": ("Metadata-Version: 2.1\nName: Demo.Pkg\nVersion: 1.0\nLicense: MIT\n\nName: body", [("Demo.Pkg", "1.0", "resolved", "pkg:pypi/demo-pkg@1.0")]),
    "package-lock-json": (
        '{"packages": {"": {"name": "app", "version": "1.0.0"}, "node_modules/a": {"version": "1.0.0", "integrity": "sha1-' + SHA1 + '"},'
        ' "node_modules/x/node_modules/@scope/tool": {"version": "3.4.5"}}}',
        [("app", "1.0.0", "project", "pkg:npm/app@1.0.0"), ("a", "1.0.0", "resolved", "pkg:npm/a@1.0.0"), ("@scope/tool", "3.4.5", "resolved", "pkg:npm/%40scope/tool@3.4.5")],
    ),
    "go-mod-text": (
        "module m\nrequire a.b/c v1.2.3\nrequire (\n  d.e/f  v0.1.0 // indirect\n\tg v2.0.0\n)\nexclude x v1",
        [("a.b/c", "v1.2.3", "runtime", "pkg:golang/a.b/c@v1.2.3"), ("d.e/f", "v0.1.0", "indirect", "pkg:golang/d.e/f@v0.1.0"), ("g", "v2.0.0", "runtime", "pkg:golang/g@v2.0.0")],
    ),
    "conservative-go-sum": ("a v1.0.0 h1:x=\na v1.0.0/go.mod h1:y=\nbad", [("a", "v1.0.0", "resolved", "pkg:golang/a@v1.0.0")] * 2),
    "maven-pom-xml": (
        "<project><groupId>g</groupId><artifactId>app</artifactId><version>1.0</version><licenses><license><name>MIT</name></license></licenses>"
        "<!-- <dependency><artifactId>no</artifactId></dependency> --><dependencies><dependency><groupId>o.g</groupId><artifactId>a</artifactId><version>2.0</version></dependency>"
        "<dependency><groupId>g</groupId><artifactId>t</artifactId><version>${v}</version><scope>test</scope></dependency>"
        "<dependency><groupId>g</groupId><artifactId>bom</artifactId><scope>import</scope></dependency></dependencies></project>",
        [("app", "1.0", "project", "pkg:maven/g/app@1.0"), ("a", "2.0", "runtime", "pkg:maven/o.g/a@2.0"), ("t", "${v}", "development", "")],
    ),
    "msbuild-package-reference": (
        '<Project><ItemGroup><PackageReference Include="A" Version="1.0.0" /><PackageReference Update="B"><Version>[2.0]</Version></PackageReference></ItemGroup></Project>',
        [("A", "1.0.0", "runtime", "pkg:nuget/A@1.0.0"), ("B", "[2.0]", "runtime", "")],
    ),
    "msbuild-central-package-xml": ('<Project><PackageVersion Include="A" Version="1.0" /></Project>', [("A", "1.0", "runtime", "pkg:nuget/A@1.0")]),
    "nuget-lock-json": (
        '{"dependencies": {"net8.0": {"A": {"type": "Direct", "resolved": "1.0.0", "requested": "[1.0.0, )"}, "B": {"requested": "[2.0, )"}}}}',
        [("A", "1.0.0", "direct", "pkg:nuget/A@1.0.0"), ("B", "[2.0, )", "resolved", "")],
    ),
    "composer-json": (
        '{"name": "v/app", "license": ["MIT", "GPL"], "require": {"a/b": "1.0.0"}, "require-dev": {"c/d": "^1"}}',
        [("v/app", "", "project", ""), ("a/b", "1.0.0", "runtime", "pkg:composer/a/b@1.0.0"), ("c/d", "^1", "development", "")],
    ),
    "composer-lock-json": (
        '{"packages": [{"name": "a/b", "version": "1.0", "license": ["MIT"]}], "packages-dev": [{"name": "c/d", "version": "2.0"}]}',
        [("a/b", "1.0", "runtime", "pkg:composer/a/b@1.0"), ("c/d", "2.0", "development", "pkg:composer/c/d@2.0")],
    ),
    "lazarus-project-xml": (
        '<CONFIG><ProjectOptions><RequiredPackages Count="1"><Item1><PackageName Value="LCL"/></Item1></RequiredPackages><Units><Item2><PackageName Value="no"/></Item2></Units></ProjectOptions></CONFIG>',
        [("LCL", "", "build", "")],
    ),
    "pipfile-lock-json": (
        '{"default": {"a": {"version": "==1.0"}, "b": "*"}, "develop": {"c": {"version": "==2.0"}}}',
        [("a", "1.0", "runtime", "pkg:pypi/a@1.0"), ("b", "*", "runtime", ""), ("c", "2.0", "development", "pkg:pypi/c@2.0")],
    ),
    "conservative-cargo-lock": (
        f'version = 3\n[[package]]\nname = "a"\nversion = "1.0.0" # c\nchecksum = "{HEX}"\n\n[[package]]\nname = "b"\nversion = "2.0.0"\n',
        [("a", "1.0.0", "resolved", "pkg:cargo/a@1.0.0"), ("b", "2.0.0", "resolved", "pkg:cargo/b@2.0.0")],
    ),
    "conservative-cargo-toml": (
        '[package]\nname = "app"\nversion = "0.1.0"\nlicense = "MIT"\nauthors = ["Ann", "Bob"]\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["x"] }\n[dev-dependencies]\nt = "2"\n',
        [("app", "0.1.0", "project", "pkg:cargo/app@0.1.0"), ("serde", "1.0", "runtime", ""), ("tokio", "1.2", "runtime", ""), ("t", "2", "development", "")],
    ),
    "conservative-poetry-lock": (
        f'[[package]]\nname = "a"\nversion = "1.0"\nfiles = [\n    {{file = "a.whl", hash = "sha256:{HEX}"}},\n]\n\n[package.dependencies]\nname = "no"\n\n[metadata]\n',
        [("a", "1.0", "resolved", "pkg:pypi/a@1.0")],
    ),
    "conservative-pyproject-toml": ('[tool.poetry]\nname = "no"\n[project]\nname = "Demo"\nversion = "1.0"\nauthors = [{name = "Ann"}]\n', [("Demo", "1.0", "project", "pkg:pypi/demo@1.0")]),
    "conservative-yarn-lock": (
        '# yarn\n\n"@s/a@^1.0.0", "@s/a@^1.1.0":\n  version "1.1.0"\n  resolved "x"\n\nb@~2:\n  version "2.0.1"\n',
        [("@s/a", "1.1.0", "resolved", "pkg:npm/%40s/a@1.1.0"), ("b", "2.0.1", "resolved", "pkg:npm/b@2.0.1")],
    ),
    "conservative-pnpm-lock": ("packages:\n  /a/1.0.0:\n  /@s/b/2.0.0(react@1):\n  x: y", [("a", "1.0.0", "resolved", "pkg:npm/a@1.0.0"), ("@s/b", "2.0.0", "resolved", "pkg:npm/%40s/b@2.0.0")]),
    "conservative-gradle-lock": ("# c\ng:a:1.0=compile\nempty=x", [("g:a", "1.0", "resolved", "pkg:maven/g/a@1.0")]),
    "conservative-gemfile-lock": ("GEM\n  specs:\n    rails (7.0)\n      dep (1.0)\n    rack (2.2)\n\nPLATFORMS\n    no (1)", [("rails", "7.0", "resolved", "pkg:gem/rails@7.0"), ("rack", "2.2", "resolved", "pkg:gem/rack@2.2")]),
    "conservative-conda-yaml": ("name: x\ndependencies:\n  - numpy=1.26=py1\n  - pip:\n  - scipy\nother:\n  - no=1", [("numpy", "1.26", "runtime", "pkg:conda/numpy@1.26"), ("scipy", "", "runtime", "")]),
    "conservative-swift-resolved-json": (
        '{"object": {"pins": [{"package": "A", "state": {"version": "1.0.0"}}, {"package": "B", "state": {"revision": "abc"}}]}}',
        [("A", "1.0.0", "resolved", "pkg:swift/A@1.0.0"), ("B", "abc", "resolved", "pkg:swift/B@abc")],
    ),
    "conservative-podfile-lock": ("PODS:\n  - A/Core (1.0):\n    - B (2.0)\n  - C (3.0)\nX:\n  - D (1)", [("A", "1.0", "resolved", "pkg:cocoapods/A@1.0"), ("C", "3.0", "resolved", "pkg:cocoapods/C@3.0")]),
    "conservative-vcpkg-json": ('{"dependencies": ["zlib", {"name": "fmt", "version>=": "10.0.0"}]}', [("zlib", "", "runtime", ""), ("fmt", "10.0.0", "runtime", "pkg:generic/fmt@10.0.0")]),
    "conservative-conan-text": ("[requires]\nzlib/1.3@user/ch\n# c\n[options]\na/b", [("zlib", "1.3", "runtime", "pkg:conan/zlib@1.3")]),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(p, p, c) for p, (c, _) in CASES.items()]
    rows += [("bad json", "package-json", "{"), ("bad xml", "maven-pom-xml", "<!DOCTYPE x><project/>"), ("empty", "requirements-text", "# nothing")]
    rows += [("legacy", "package-lock-json", '{"dependencies": {"a": {"version": "1.0.0", "integrity": "sha512-' + SHA512 + '", "dependencies": {"b": {"version": "2.0.0"}}}}}')]
    rows += [("strict", "installed-package-json", '{"name": "-a", "version": "1"}')]
    files = spark.createDataFrame(rows, "relative_path string, parser string, content string")
    found = parse.components(files).cache()
    return sorted(found.collect(), key=lambda r: r["place"]), parse.outcomes(files, found).collect()


@pytest.mark.parametrize("parser", list(CASES))
def test_rows_of_each_format(parsed, parser):
    found = [r for r in parsed[0] if r["relative_path"] == parser]
    assert [(r["name"], r["version"], r["dependency_scope"], r["package_url"]) for r in found] == CASES[parser][1]


def test_every_parser_has_a_case():
    assert set(CASES) == set(parse.PARSERS)


def test_declarations_and_hashes(parsed):
    rows = {(r["relative_path"], r["name"]): r for r in parsed[0]}
    assert rows["package-json", "app"]["declared_licenses"] == ["MIT"] and rows["package-json", "app"]["declared_publishers"] == ["Ann"]
    assert rows["composer-json", "v/app"]["declared_licenses"] == ["MIT", "GPL"]
    assert rows["conservative-cargo-toml", "app"]["declared_publishers"] == ["Ann", "Bob"]
    assert rows["conservative-pyproject-toml", "Demo"]["declared_publishers"] == ["Ann"]
    assert [tuple(h) for h in rows["conservative-cargo-lock", "a"]["hashes"]] == [("SHA-256", HEX, "a@1.0.0")]
    assert [tuple(h) for h in rows["conservative-poetry-lock", "a"]["hashes"]] == [("SHA-256", HEX, "a.whl")]
    assert [tuple(h) for h in rows["package-lock-json", "a"]["hashes"]] == [("SHA-1", hashlib.sha1(b"x").hexdigest(), "a@1.0.0")]
    assert rows["legacy", "a"]["hashes"][0]["digest"] == hashlib.sha512(b"x").hexdigest() and ("legacy", "b") in rows


def test_outcomes_are_per_file(parsed):
    got = {r["relative_path"]: r for r in parsed[1]}
    assert got["bad json"]["status"] == got["bad xml"]["status"] == got["strict"]["status"] == "failed"
    assert got["empty"]["status"] == "parsed" and "No dependency" in got["empty"]["message"]
    assert got["conservative-go-sum"]["status"] == "partially parsed" and got["conservative-go-sum"]["component_count"] == 2
    assert got["package-json"]["status"] == "parsed" and got["package-json"]["message"] == ""
