"""Manifest and lock-file parsers as DataFrame transformations.

Files come as (relative_path, parser, content); each parser turns the files of its kind
into component rows with Spark's own functions: texts are split into lines or blocks, and
regular expressions and from_json read them. Only XML and npm lock files go through Python
workers, which turn each file or tree into rows. place keeps a file's row order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import canonical_sha256, sri_hashes
from ..functions.identity import CARGO_MANIFEST
from ..functions.purl import maven_url, package_url
from ..functions.text import lower, present, trim
from ..functions.versions import is_exact_in
from .strict_json import json_error
from .xml_events import xml_error, xml_events

HASHES = "array<struct<algorithm:string,digest:string,subject:string>>"
TEXTS = "array<string>"
ROW = ["relative_path", "place", "name", "version", "ecosystem", "scope", "component_type", "licenses", "publishers", "hashes", "purl"]


def _rows(df: DataFrame, ecosystem: str, **columns: Column | str) -> DataFrame:
    """The common row shape; columns that a parser doesn't give are empty."""
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    base = {
        "place": F.lit(0), "version": F.lit(""), "scope": F.lit("resolved"), "component_type": F.lit("library"),
        "licenses": F.lit(None), "publishers": F.lit(None), "hashes": F.lit(None), "purl": F.lit(None), "ecosystem": F.lit(ecosystem),
    } | given
    kinds = {"place": "long", "licenses": TEXTS, "publishers": TEXTS, "hashes": HASHES}
    return df.select("relative_path", *[base[c].cast(kinds.get(c, "string")).alias(c) for c in ROW[1:]])


def lines(files: DataFrame) -> DataFrame:
    """relative_path, place, line: any line ending parts."""
    return files.select("relative_path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("place", "line"))


def blocks(files: DataFrame, header: str, content: Column | str = "content") -> DataFrame:
    """relative_path, place, head, body: the text from each line that matches header
    (a regular expression for a whole line) up to the next."""
    source = F.col(content) if isinstance(content, str) else content
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(source, r"\r\n?", "\n")), rf"\n(?=[ \t]*(?:{header})[ \t]*(?:\n|\z))")
    out = files.select("relative_path", F.posexplode(F.slice(parts, 2, 1 << 30)).alias("place", "block"))
    return out.select("relative_path", "place", trim(F.regexp_extract("block", r"^([^\n]*)", 1)).alias("head"), F.regexp_replace("block", r"^[^\n]*\n?", "").alias("body"))


def _match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


# line-oriented formats


def requirements(files: DataFrame) -> DataFrame:
    line = trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    rows = lines(files).withColumn("line", line).where("line <> '' and substring(line, 1, 1) not in ('#', '-')")
    rows = rows.withColumn("line", trim(_match(F.col("line"), r"^([^;]*)")))
    direct = F.col("line").contains(" @ ")
    exact3, exact2 = F.col("line").contains("==="), F.col("line").contains("==")
    name = (
        F.when(direct, _match(F.col("line"), r"^(.*?) @ "))
        .when(exact3, _match(F.col("line"), r"^(.*?)==="))
        .when(exact2, _match(F.col("line"), r"^(.*?)=="))
        .otherwise(_match(F.col("line"), r"^([^<>~!=]*)"))
    )
    version = (
        F.when(direct, "")
        .when(exact3, _match(F.col("line"), r"===(.*)$"))
        .when(exact2, _match(F.col("line"), r"^.*?==(.*)$"))
        .otherwise(_match(F.col("line"), r"^[^<>~!=]*(.*)$"))
    )
    return _rows(rows, "PyPI", place=F.col("place"), name=F.when(direct, name).otherwise(_match(name, r"^([^\[]*)")), version=version, scope="runtime")


def go_mod(files: DataFrame) -> DataFrame:
    """Requirements of single lines and of blocks; a line's block is the last opening or
    closing line before it."""
    rows = lines(files).withColumn("line", trim(F.col("line")))
    mark = F.when(F.col("line") == "require (", True).when(F.col("line") == ")", False)
    before = W.partitionBy("relative_path").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)))
    rows = rows.where((F.col("inside") | F.col("line").startswith("require ")) & ~F.col("line").isin("require (", ")"))
    body = F.when(F.col("inside"), F.col("line")).otherwise(F.regexp_replace("line", "^require ", ""))
    indirect = body.contains("// indirect")
    parts = F.split(F.regexp_replace(trim(_match(body, r"^(.*?)(?:// indirect.*)?$")), " +", " "), " ")
    rows = rows.withColumns({"parts": parts, "indirect": indirect}).where("size(parts) >= 2")
    scope = F.when(F.col("indirect"), "indirect").otherwise("runtime")
    return _rows(rows, "Go", place=F.col("place"), name=F.col("parts")[0], version=F.col("parts")[1], scope=scope)


def go_sum(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumn("parts", F.split(F.regexp_replace(trim(F.col("line")), " +", " "), " ")).where("size(parts) >= 2")
    return _rows(rows, "Go", place=F.col("place"), name=F.col("parts")[0], version=F.regexp_replace(F.col("parts")[1], r"/go\.mod.*$", ""))


def gradle_lock(files: DataFrame) -> DataFrame:
    rows = lines(files).withColumn("line", trim(F.col("line"))).where("line <> '' and not startswith(line, '#')")
    rows = rows.withColumn("parts", F.split(_match(F.col("line"), "^([^=]*)"), ":")).where("size(parts) >= 3")
    name = F.concat_ws(":", F.col("parts")[0], F.col("parts")[1])
    return _rows(rows, "Gradle", place=F.col("place"), name=name, version=F.col("parts")[2])


def pnpm_lock(files: DataFrame) -> DataFrame:
    pattern = r"^/(.+)/([^/]*):$"
    rows = lines(files).withColumn("line", trim(F.col("line"))).where(F.col("line").rlike(pattern) & (F.length("line") >= 4))
    return _rows(rows, "npm", place=F.col("place"), name=_match(F.col("line"), pattern), version=_match(_match(F.col("line"), pattern, 2), r"^([^(]*)"))


def _section(files: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Lines after a line that opens a section, up to one that closes it."""
    rows = lines(files)
    before = W.partitionBy("relative_path").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(opens, True).when(closes, False)
    return rows.withColumn("inside", F.last(mark, ignorenulls=True).over(before)).where(F.col("inside") & ~opens)




def gem_lock(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = _section(files, trim(line) == "specs:", (line != "") & ~line.startswith(" "))
    rows = rows.where(line.rlike(r"^    (?!  ).*? \([^)]*\)"))
    return _rows(rows, "RubyGems", place=F.col("place"), name=_match(trim(line), r"^(.*?) \("), version=_match(line, r" \((.*?)\)"))


def podfile_lock(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = _section(files, trim(line) == "PODS:", (line != "") & ~line.rlike(r"^[ \t]")).where(line.rlike(r"^  - .*? \([^)]*\)"))
    item = trim(F.substring(line, 5, 1 << 20))
    return _rows(rows, "CocoaPods", place=F.col("place"), name=_match(_match(item, r"^(.*?) \("), "^([^/]*)"), version=_match(item, r" \((.*?)\)"))


def conda(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = _section(files, trim(line) == "dependencies:", (line != "") & ~line.rlike(r"^[ \t]"))
    rows = rows.withColumn("line", trim(line)).where("startswith(line, '- ')").withColumn("line", F.substring("line", 3, 1 << 20))
    rows = rows.where("line not in ('pip:', '')")
    return _rows(rows, "Conda", place=F.col("place"), name=_match(F.col("line"), "^([^=]*)"), version=_match(F.col("line"), "^[^=]*=([^=]*)"), scope="runtime")


def conan(files: DataFrame) -> DataFrame:
    line = F.col("line")
    head = trim(line).rlike(r"^\[..")
    rows = _section(files, head & (lower(trim(line)) == "[requires]"), head)
    rows = rows.withColumn("line", trim(line)).where(F.col("line").contains("/") & ~F.col("line").startswith("#"))
    return _rows(rows, "Conan", place=F.col("place"), name=_match(F.col("line"), "^([^/]*)"), version=_match(F.col("line"), "^[^/]*/([^@]*)"), scope="runtime")


def yarn_lock(files: DataFrame) -> DataFrame:
    rows = blocks(files, r"[^ \t#\n][^\n]*:").where(~F.col("head").rlike(r"^[ \t#]"))
    first = F.regexp_replace(_match(F.col("head"), r"^([^,]*?):?$|^([^,]*)"), r":$", "")
    first = F.when(F.col("head").contains(","), _match(F.col("head"), "^([^,]*)")).otherwise(first)
    spec = _unquoted(first)
    version = _unquoted(_match(F.col("body"), r"(?:^|\n)[ \t]*version[ ]+([^\n]*)"))
    return _rows(rows, "npm", place=F.col("place"), name=_match(spec, r"^(@?[^@]*)"), version=version)


def dist_info(files: DataFrame) -> DataFrame:
    """One Name and one Version among the headers, else the file fails (no row)."""
    head = _match(F.concat(F.regexp_replace("content", r"\r\n?", "\n"), F.lit("\n\n")), r"(?s)^(.*?)\n\n")
    unfolded = F.regexp_replace(head, r"\n[ \t]+", " ")
    of = lambda k: F.regexp_extract_all(unfolded, F.lit(rf"(?im)^{k}:[ \t]*(.*)$"), F.lit(1))
    rows = files.withColumns({"names": of("Name"), "versions": of("Version"), "lic": of("License(?:-Expression)?"), "who": of("Author")})
    rows = rows.where("size(names) = 1 and size(versions) = 1")
    name, version = trim(F.col("names")[0]), trim(F.col("versions")[0])
    ok = name.rlike(r"^[A-Za-z0-9]([A-Za-z0-9._\-]*[A-Za-z0-9])?\z") & is_exact_in(F.lit("PyPI"), version)
    return _rows(rows.where(ok), "PyPI", name=name, version=version, licenses=F.col("lic"), publishers=F.col("who"))


# TOML


def _unquoted(c: Column) -> Column:
    value = trim(c)
    return F.when(value.rlike("""^"[^"]*"$|^'[^']*'$"""), F.substring(value, 2, F.length(value) - 2)).otherwise(F.regexp_replace(value, """^["']|["']$""", ""))


def _toml(body: Column, key: str) -> Column:
    """A single-line literal string assignment; empty if there is none."""
    found = rf"""(?m)^[ \t]*{key}[ \t]*=[ \t]*(?:"([^"\\\n]*)"|'([^'\n]*)')[ \t]*(?:#.*)?$"""
    return F.concat(_match(body, found, 1), _match(body, found, 2))


def _toml_list(body: Column, key: str) -> Column:
    inside = _match(body, rf"(?m)^[ \t]*{key}[ \t]*=[ \t]*\[([^\]\n]*)\]")
    return F.regexp_extract_all(inside, F.lit("""["']([^"']*)["']"""), F.lit(1))


SECTION = r"\[[^\n]*\]"


def _one(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v != "")


def cargo_lock(files: DataFrame) -> DataFrame:
    rows = blocks(files, r"\[\[package\]\]")
    body = F.regexp_replace("body", rf"(?s)\n[ \t]*\[.*$", "")
    name, version, checksum = (_toml(body, k) for k in ("name", "version", "checksum"))
    digest = canonical_sha256(checksum)
    subject = F.concat(trim(name), F.lit("@"), trim(version))
    one = F.struct(F.lit("SHA-256").alias("algorithm"), digest.alias("digest"), subject.alias("subject"))
    hashes = F.when((digest != "") & is_exact_in(F.lit("Cargo"), version), F.array(one))
    return _rows(rows, "Cargo", place=F.col("place"), name=name, version=version, hashes=hashes)


def cargo_toml(files: DataFrame) -> DataFrame:
    sections = blocks(files, SECTION)
    head = trim(_match(F.col("head"), r"^\[(.*)\]"))
    project = sections.where(head == "package")
    project = _rows(
        project, "Cargo", place=F.lit(-1), name=_toml(F.col("body"), "name"), version=_toml(F.col("body"), "version"), scope="project",
        component_type="application", licenses=_one(_toml(F.col("body"), "license")), publishers=_toml_list(F.col("body"), "authors"),
    )
    scope = F.when(head == "dependencies", "runtime").when(head == "dev-dependencies", "development").when(head == "build-dependencies", "build")
    rows = sections.withColumn("scope", scope).where("scope is not null")
    rows = rows.select("relative_path", "scope", F.col("place").alias("at"), F.posexplode(F.split("body", "\n")).alias("n", "line"))
    rows = rows.withColumn("line", trim(F.regexp_replace("line", r"""(^|\s)#[^"']*$""", ""))).where(F.col("line").contains("=") & ~F.col("line").startswith("["))
    value = trim(_match(F.col("line"), "^[^=]*=(.*)$"))
    table = _match(value, r"(?i)^\{.*?version[ \t]*=?([^,}]*)")
    version = F.when(value.startswith("{"), table).otherwise(value)
    declared = _rows(rows, "Cargo", place=F.col("at") * 1_000_000 + F.col("n"), name=_unquoted(_match(F.col("line"), "^([^=]*)=")), version=_unquoted(version), scope=F.col("scope"))
    return project.unionByName(declared)


def poetry_lock(files: DataFrame) -> DataFrame:
    rows = blocks(files, r"\[\[package\]\]")
    body = F.regexp_replace("body", r"(?s)\n[ \t]*\[[^\n]*\][ \t]*\n.*$", "\n")
    name, version = _toml(body, "name"), _toml(body, "version")
    entries = F.regexp_extract_all(_match(body, r"(?s)\bfiles[ \t]*=[ \t]*\[(.*?)\n?\]"), F.lit(r"(\{[^}]*\})"), F.lit(1))
    one = lambda e: F.struct(
        F.lit("SHA-256").alias("algorithm"),
        canonical_sha256(_match(e, r"""hash[ \t]*=[ \t]*["']sha256:([0-9A-Fa-f]+)["']""")).alias("digest"),
        _match(e, r"""file[ \t]*=[ \t]*["']([^"']*)["']""").alias("subject"),
    )
    hashes = F.when(is_exact_in(F.lit("PyPI"), version), F.filter(F.transform(entries, one), lambda h: h["digest"] != ""))
    return _rows(rows, "PyPI", place=F.col("place"), name=name, version=version, hashes=hashes)


def pyproject(files: DataFrame) -> DataFrame:
    """The project's own identity; a [project] table wins over [tool.poetry]."""
    sections = blocks(files, SECTION)
    body = F.col("body")
    authors = _match(body, r"(?m)^[ \t]*authors[ \t]*=[ \t]*\[([^\]\n]*)\]")
    own = F.struct(
        _toml(body, "name").alias("name"), _toml(body, "version").alias("version"), _one(_toml(body, "license")).alias("licenses"),
        F.when(authors.contains("{"), F.regexp_extract_all(authors, F.lit("""name[ \t]*=[ \t]*["']([^"']*)["']"""), F.lit(1))).otherwise(_toml_list(body, "authors")).alias("who"),
    )
    rank = F.when(F.col("head") == "[project]", 0).when(F.col("head") == "[tool.poetry]", 1)
    rows = sections.withColumns({"own": own, "rank": rank}).where("rank is not null and own.name <> ''")
    rows = rows.groupBy("relative_path").agg(F.min_by("own", "rank").alias("own"))
    return _rows(rows, "PyPI", name=F.col("own.name"), version=F.col("own.version"), scope="project", component_type="application", licenses=F.col("own.licenses"), publishers=F.col("own.who"))


# JSON


def _json(files: DataFrame, schema: str) -> DataFrame:
    """j, the document read by a schema; files that aren't strict JSON, or whose root is no
    object, are left out."""
    sound = F.col("content").rlike(r"^[\x00-\x20]*+\{") & (json_error(F.col("content")) == "")
    # generated, so that no filter is moved below what makes or deals out the documents, where
    # it would make and judge them again, and those on j read the document once
    judged = files.select("*", F.explode(F.array(sound)).alias("_sound")).where("_sound").drop("_sound")
    return judged.select("*", F.explode(F.array(F.from_json("content", schema))).alias("j"))


def _entries(df: DataFrame, column: str) -> DataFrame:
    """A row per entry of a map column, in the order of the document."""
    return df.select("*", F.posexplode(F.map_entries(column)).alias("place", "entry"))


def _scalar(text: Column) -> Column:
    """A JSON value kept as text: objects and arrays count as empty."""
    return F.when(present(text).rlike(r"^\s*[\[{]"), "").otherwise(present(text))


def _declared(text: Column, *fields: str) -> Column:
    """Texts of a declaration that is a string, an object with one of the fields, or a
    list of such."""
    item = lambda t: F.when(t.startswith("{"), F.coalesce(*[F.get_json_object(t, f"$.{f}") for f in fields], F.lit(""))).otherwise(t)
    value = trim(present(text))
    listed = F.from_json(value, "array<string>")
    found = F.when(value.startswith("["), listed).otherwise(F.array(value))
    return F.filter(F.transform(found, lambda t: trim(item(t))), lambda t: (t != "") & (F.octet_length(t) <= 4096) & ~t.rlike(r"[\x00-\x1F\x7F]"))


NPM_MAPS = {"dependencies": "runtime", "devDependencies": "development", "optionalDependencies": "optional", "peerDependencies": "peer"}


def package_json(files: DataFrame) -> DataFrame:
    maps = ", ".join(f"{k} map<string,string>" for k in NPM_MAPS)
    rows = _json(files, f"name string, version string, license string, author string, {maps}")
    project = _rows(
        rows, "npm", place=F.lit(-1), name=F.col("j.name"), version=present("j.version"), scope="project", component_type="application",
        licenses=_declared(F.col("j.license"), "type"), publishers=_declared(F.col("j.author"), "name", "email"),
    )
    out = [project]
    for n, (k, scope) in enumerate(NPM_MAPS.items()):
        each = _entries(rows, f"j.{k}")
        out.append(_rows(each, "npm", place=F.lit(n * 1_000_000) + F.col("place"), name=F.col("entry.key"), version=_scalar(F.col("entry.value")), scope=scope))
    return reduce(DataFrame.unionByName, out)


def installed_package(files: DataFrame) -> DataFrame:
    """The package itself; a file without a strict name and semantic version fails."""
    rows = _json(files, "name string, version string, license string, author string")
    word = r"[A-Za-z0-9](?:[A-Za-z0-9._~\-]*[A-Za-z0-9])?"
    number, tag = r"(?:0|[1-9][0-9]*)", r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z\-][0-9A-Za-z\-]*)"
    semver = rf"^{number}\.{number}\.{number}(?:-{tag}(?:\.{tag})*)?(?:\+[0-9A-Za-z\-]+(?:\.[0-9A-Za-z\-]+)*)?\z"
    ok = F.col("j.name").rlike(rf"^(?:@{word}/)?{word}\z") & F.col("j.version").rlike(semver)
    return _rows(
        rows.where(ok), "npm", name=F.col("j.name"), version=F.col("j.version"),
        licenses=_declared(F.col("j.license"), "type"), publishers=_declared(F.col("j.author"), "name", "email"),
    )


def _integrity(name: Column, version: Column, integrity: Column) -> Column:
    subject = F.concat(trim(name), F.lit("@"), trim(version))
    found = F.transform(sri_hashes(present(integrity)), lambda h: F.struct(h["algorithm"], h["digest"], subject.alias("subject")))
    return F.when(is_exact_in(F.lit("npm"), version), found).cast(HASHES)


LOCK_ENTRY = "struct<name:string,version:string,integrity:string,dependencies:string>"


def package_lock(files: DataFrame) -> DataFrame:
    """The packages map, or else the nested dependencies of older files, at any depth and in
    the order of the document. Both forms take one pass, in which texts follow each other and
    no column of them is held."""
    rows = _json(files, f"packages map<string,{LOCK_ENTRY}>, dependencies string")
    tree = F.when(F.col("j.packages").isNull(), F.col("j.dependencies"))
    each = rows.select("relative_path", tree.alias("tree"), F.map_entries("j.packages").alias("listed"))
    each = each.select("relative_path", "tree", F.posexplode_outer("listed").alias("place", "entry"))
    each = each.where("tree is not null or entry.value is not null")
    found = each.select("relative_path", "tree", F.col("place").cast("long"), "entry.key", "entry.value.name", "entry.value.version", "entry.value.integrity").mapInArrow(_lock_rows, f"{LOCK_ROWS}, key string")
    key, stated = F.col("key"), present("name")
    from_path = _match(key, r"(?s)^(?:.*node_modules/)?(.*)$")
    name = F.when(key.isNull() | (stated != ""), stated).otherwise(from_path)
    version = present("version")
    project = F.coalesce(key == "", F.lit(False))
    return _rows(
        found, "npm", place=F.col("place"), name=name, version=version, hashes=_integrity(name, version, F.col("integrity")),
        scope=F.when(project, "project").otherwise("resolved"), component_type=F.when(project, "application").otherwise("library"),
    )


LOCK_ROWS = "relative_path string, place long, name string, version string, integrity string"


def _lock_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of packages maps as they are, and those of trees, which have no key."""
    names = ["relative_path", "place", "name", "version", "integrity", "key"]
    for batch in batches:
        older, listed = batch, None
        if batch.column(1).null_count:
            older, listed = batch.filter(batch.column(1).is_valid()), batch.filter(batch.column(1).is_null()).select(names)
        for rows in _walk(iter([older])):
            yield rows.append_column("key", pa.nulls(rows.num_rows, pa.string()))
        if listed is not None:
            yield listed


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each tree of dependencies, each before those nested in it."""
    text = lambda v: "" if v is None or isinstance(v, dict | list) else json.dumps(v)
    columns: tuple[list, ...] = ([], [], [], [], [])  # of several files, so that small ones share a batch
    paths, places, names, versions, integrities = columns

    def handed() -> pa.RecordBatch:
        made = [pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(columns)]
        for c in columns:
            c.clear()
        return pa.RecordBatch.from_arrays(made, names=["relative_path", "place", "name", "version", "integrity"])

    for batch in batches:
        for path, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            place, root = 0, json.loads(tree.as_py())
            way = [iter(root.items() if isinstance(root, dict) else ())]
            while way:
                for name, entry in way[-1]:
                    if not isinstance(entry, dict):
                        continue
                    version, integrity, below = entry.get("version"), entry.get("integrity"), entry.get("dependencies")
                    paths.append(path)
                    places.append(place)
                    names.append(name)
                    versions.append(version if isinstance(version, str) else text(version))
                    integrities.append(integrity if isinstance(integrity, str) else text(integrity))
                    place += 1
                    if len(paths) == 4096:
                        yield handed()
                    if below and isinstance(below, dict):
                        way.append(iter(below.items()))
                        break
                else:
                    way.pop()
    if paths:
        yield handed()


def pipfile_lock(files: DataFrame) -> DataFrame:
    rows = _json(files, "default map<string,string>, develop map<string,string>")
    out = []
    for n, (k, scope) in enumerate((("default", "runtime"), ("develop", "development"))):
        each = _entries(rows, f"j.{k}")
        value = present("entry.value")
        version = F.when(value.startswith("{"), present(F.get_json_object(value, "$.version"))).otherwise(_scalar(value))
        out.append(_rows(each, "PyPI", place=F.lit(n * 1_000_000) + F.col("place"), name=F.col("entry.key"), version=F.regexp_replace(version, "^==", ""), scope=scope))
    return out[0].unionByName(out[1])


def nuget_lock(files: DataFrame) -> DataFrame:
    rows = _json(files, "dependencies map<string,map<string,struct<type:string,resolved:string,requested:string>>>")
    each = rows.select("relative_path", F.posexplode(F.map_entries("j.dependencies")).alias("f", "framework"))
    each = each.select("relative_path", "f", F.posexplode(F.map_entries("framework.value")).alias("n", "entry"))
    version = F.coalesce(F.nullif("entry.value.resolved", F.lit("")), F.col("entry.value.requested"), F.lit(""))
    scope = F.coalesce(F.nullif(lower(F.col("entry.value.type")), F.lit("")), F.lit("resolved"))
    return _rows(each, "NuGet", place=F.col("f") * 1_000_000 + F.col("n"), name=F.col("entry.key"), version=version, scope=scope)


def composer_json(files: DataFrame) -> DataFrame:
    dev = "`require-dev`"
    rows = _json(files, f"name string, version string, license string, authors string, require map<string,string>, {dev} map<string,string>")
    project = _rows(
        rows, "Composer", place=F.lit(-1), name=F.col("j.name"), version=present("j.version"), scope="project", component_type="application",
        licenses=_declared(F.col("j.license"), "type"), publishers=_declared(F.col("j.authors"), "name", "email"),
    )
    out = [project]
    for n, (k, scope) in enumerate((("require", "runtime"), (dev, "development"))):
        each = _entries(rows, f"j.{k}")
        out.append(_rows(each, "Composer", place=F.lit(n * 1_000_000) + F.col("place"), name=F.col("entry.key"), version=_scalar(F.col("entry.value")), scope=scope))
    return reduce(DataFrame.unionByName, out)


def composer_lock(files: DataFrame) -> DataFrame:
    package = "array<struct<name:string,version:string,license:string,authors:string>>"
    rows = _json(files, f"packages {package}, `packages-dev` {package}")
    out = []
    for n, (k, scope) in enumerate((("packages", "runtime"), ("`packages-dev`", "development"))):
        each = rows.select("relative_path", F.posexplode(f"j.{k}").alias("place", "p"))
        out.append(
            _rows(
                each, "Composer", place=F.lit(n * 1_000_000) + F.col("place"), name=F.col("p.name"), version=present("p.version"), scope=scope,
                licenses=_declared(F.col("p.license"), "type"), publishers=_declared(F.col("p.authors"), "name", "email"),
            )
        )
    return out[0].unionByName(out[1])


def swift_resolved(files: DataFrame) -> DataFrame:
    pin = "array<struct<identity:string,package:string,state:struct<version:string,revision:string>>>"
    rows = _json(files, f"pins {pin}, object struct<pins:{pin}>")
    each = rows.select("relative_path", F.posexplode(F.coalesce("j.pins", "j.object.pins")).alias("place", "p"))
    name = F.coalesce(F.nullif("p.identity", F.lit("")), F.col("p.package"))
    return _rows(each, "Swift", place=F.col("place"), name=name, version=F.coalesce(F.nullif("p.state.version", F.lit("")), F.col("p.state.revision"), F.lit("")))


def vcpkg(files: DataFrame) -> DataFrame:
    each = _json(files, "dependencies array<string>").select("relative_path", F.posexplode("j.dependencies").alias("place", "d"))
    item = F.from_json("d", "name string, `version>=` string")
    whole = F.col("d").startswith("{")
    version = F.when(whole, present(item["version>="])).otherwise("")
    return _rows(each, "vcpkg", place=F.col("place"), name=F.when(whole, item["name"]).otherwise(_scalar(F.col("d"))), version=version, scope="runtime")


# XML: filters over the elements of all files


def _first(text: Column, at: str, when: Column) -> Column:
    """The trimmed text of the first element where a condition holds; else empty."""
    return F.coalesce(trim(F.min_by(F.when(when, present(text)), F.when(when, F.col(at)))), F.lit(""))


def maven_pom(files: DataFrame) -> DataFrame:
    """Every dependency element at any depth but in another, with its direct children; the
    project itself only if it declares a license or an organization (names that it
    inherits or computes don't count). Names are artifact ids."""
    each = xml_events(files)
    name = F.regexp_extract("folded", r"([^/\[]*)\[[0-9]+\]$", 1)
    inside = F.col("folded").rlike(r"^(?:.*/)?dependency\[[0-9]+\]/[^/]*$") & ~F.col("folded").rlike(r"(?:^|/)dependency\[[0-9]+\]/.*/")
    field = lambda k: _first(F.col("text"), "node", name == k).alias(k)
    fields = ("groupid", "artifactid", "version", "scope", "optional")
    rows = each.where(inside).groupBy("relative_path", F.col("parent").alias("place")).agg(*[field(k) for k in fields])
    group, artifact, version, scope = (F.col(k) for k in fields[:4])
    scope = lower(scope)
    kind = (
        F.when(lower(F.col("optional")) == "true", "optional")
        .when(scope.isin("", "compile", "runtime"), "runtime")
        .when(scope == "test", "development")
        .otherwise(scope)
    )
    out = _rows(rows.where(scope != "import"), "Maven", place=F.col("place"), name=artifact, version=version, scope=kind, purl=maven_url(group, artifact, version))
    at = lambda path, column="folded": F.col(column).rlike(rf"^[^/]+/{path}$")
    of = lambda path, column="folded": _first(F.col("text"), "node", at(path, column))
    license_name = at(r"licenses\[1\]/license\[[0-9]+\]/name\[1\]", "path")
    top = each.where(F.col("folded").rlike(r"^[^/]+/(?:groupid|artifactid|version|parent\[1\]/[a-z]+|organization|licenses)\b")).groupBy("relative_path").agg(
        of(r"groupid\[1\]").alias("g"), of(r"artifactid\[1\]").alias("a"), of(r"version\[1\]").alias("v"),
        of(r"parent\[1\]/groupid\[1\]").alias("pg"), of(r"parent\[1\]/version\[1\]").alias("pv"),
        of(r"organization\[1\]/name\[1\]", "path").alias("who"),
        F.sort_array(F.collect_list(F.when(license_name, F.struct("node", trim(present("text")).alias("text"))))).getField("text").alias("licenses"),
    )
    literal = lambda v: (v != "") & ~v.contains("${")
    licenses, who = F.filter("licenses", literal), F.filter(F.array("who"), literal)
    group, version = F.coalesce(F.nullif("g", F.lit("")), F.col("pg")), F.coalesce(F.nullif("v", F.lit("")), F.col("pv"))
    project = _rows(
        top.where((F.col("a") != "") & ((F.size(licenses) > 0) | (F.size(who) > 0))), "Maven", place=F.lit(-1), name=F.col("a"), version=version,
        scope="project", component_type="application", licenses=licenses, publishers=who, purl=maven_url(group, F.col("a"), version),
    )
    return project.unionByName(out)


def _msbuild(files: DataFrame, tag: str) -> DataFrame:
    """Elements of a name in any case; the version is an attribute or else a child."""
    each = xml_events(files)
    own = F.col("folded").rlike(rf"(?:^|/){tag}\[[0-9]+\]$")
    child = F.col("folded").rlike(rf"(?:^|/){tag}\[[0-9]+\]/version\[1\]$")
    rows = each.where(own | child).groupBy("relative_path", F.when(own, F.col("node")).otherwise(F.col("parent")).alias("place"))
    attribute = lambda k: F.coalesce(F.max(F.when(own, F.try_element_at("attributes", F.lit(k)))), F.lit("")).alias(k)
    rows = rows.agg(*[attribute(k) for k in ("Include", "Update", "Version")], _first(F.col("text"), "node", child).alias("below"))
    or_else = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.col(b))
    return _rows(rows, "NuGet", place=F.col("place"), name=or_else("Include", "Update"), version=or_else("Version", "below"), scope="runtime")


def msbuild(files: DataFrame) -> DataFrame:
    return _msbuild(files, "packagereference")


def central_packages(files: DataFrame) -> DataFrame:
    return _msbuild(files, "packageversion")


def lazarus(files: DataFrame) -> DataFrame:
    """Item elements anywhere in RequiredPackages: the Value, or else the text, of their
    PackageName, or of their Name if they have none."""
    inside = F.col("folded").rlike(r"(?:^|/)requiredpackages\[[0-9]+\]/(?:.*/)?item[^/]*/(?:packagename|name)\[1\]$") & F.col("path").rlike(r"(?:^|/)Item[^/]*/[^/]*$")
    rank = F.when(F.col("folded").endswith("/packagename[1]"), 0).otherwise(1)
    value = F.coalesce(F.nullif(F.try_element_at("attributes", F.lit("Value")), F.lit("")), trim(present("text")))
    rows = xml_events(files).where(inside).groupBy("relative_path", F.col("parent").alias("place")).agg(F.min_by(value, rank).alias("name"))
    return _rows(rows, "FreePascal", place=F.col("place"), name=F.col("name"), scope="build")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "package-json": package_json, "installed-package-json": installed_package, "python-dist-info-metadata": dist_info,
    "package-lock-json": package_lock, "requirements-text": requirements, "go-mod-text": go_mod, "conservative-go-sum": go_sum,
    "maven-pom-xml": maven_pom, "msbuild-package-reference": msbuild, "msbuild-central-package-xml": central_packages,
    "nuget-lock-json": nuget_lock, "composer-json": composer_json, "composer-lock-json": composer_lock, "lazarus-project-xml": lazarus,
    "pipfile-lock-json": pipfile_lock, "conservative-cargo-lock": cargo_lock, CARGO_MANIFEST: cargo_toml,
    "conservative-poetry-lock": poetry_lock, "conservative-pyproject-toml": pyproject, "conservative-yarn-lock": yarn_lock,
    "conservative-pnpm-lock": pnpm_lock, "conservative-gradle-lock": gradle_lock, "conservative-gemfile-lock": gem_lock,
    "conservative-conda-yaml": conda, "conservative-swift-resolved-json": swift_resolved, "conservative-podfile-lock": podfile_lock,
    "conservative-vcpkg-json": vcpkg, "conservative-conan-text": conan,
}
JSON_PARSERS = [p for p in PARSERS if p.endswith("-json")]
XML_PARSERS = [p for p in PARSERS if p.endswith("-xml") or p.startswith("msbuild")]
STRICT_PARSERS = ["installed-package-json", "python-dist-info-metadata"]


def components(files: DataFrame, parsers: list[str] | None = None) -> DataFrame:
    """Component rows of all files: relative_path, place, the fields that files state,
    and the package URL. Rows without a name are dropped; dependencies of a Cargo
    manifest state requirements and get no package URL."""
    out = [
        PARSERS[p](files.where(F.col("parser") == p).select("relative_path", "content")).withColumn("source_parser", F.lit(p))
        for p in parsers or PARSERS
    ]
    rows = reduce(DataFrame.unionByName, out)
    rows = rows.withColumns({"name": trim(present("name")), "version": trim(present("version"))})
    name, version = F.col("name"), F.col("version")
    requirement = (F.col("source_parser") == CARGO_MANIFEST) & (F.col("scope") != "project")
    built = package_url(F.col("ecosystem"), name, version)
    purl = F.coalesce(F.col("purl"), F.when(requirement, "").otherwise(built))
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast(TEXTS)), trim), lambda v: v != "")
    return rows.where(name != "").select(
        "relative_path", "place", "component_type", "name", "version", "ecosystem", purl.alias("package_url"),
        "source_parser", F.col("scope").alias("dependency_scope"), clean(F.col("licenses")).alias("declared_licenses"),
        clean(F.col("publishers")).alias("declared_publishers"), F.coalesce("hashes", F.array().cast(HASHES)).alias("hashes"),
    )


def outcomes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """relative_path, status, message, component_count of each file: a malformed JSON or
    unsafe XML file fails alone, with no rows; so does a strict format without its row."""
    counts = rows.groupBy("relative_path").agg(F.count(F.lit(1)).cast("int").alias("component_count"))
    content = F.col("content")
    is_json, is_xml = F.col("parser").isin(JSON_PARSERS), F.col("parser").isin(XML_PARSERS)
    judged = reduce(
        DataFrame.unionByName,
        [
            files.where(is_json).select("relative_path", "parser", ((json_error(content) != "") | ~trim(content).startswith("{")).alias("broken")),
            files.where(is_xml).select("relative_path", "parser", (xml_error(content) != "").alias("broken")),
            files.where(~is_json & ~is_xml).select("relative_path", "parser", F.lit(False).alias("broken")),
        ],
    )
    out = judged.join(counts, "relative_path", "left").fillna(0, ["component_count"])
    failed = F.col("broken") | (F.col("parser").isin(STRICT_PARSERS) & (F.col("component_count") == 0))
    part = F.col("parser").startswith("conservative-") | (F.col("parser") == "pipfile-lock-json")
    none = F.when(~failed & (F.col("component_count") == 0), "No dependency components were identified.")
    more = F.when(failed, "The file is malformed.").when(part, "The format may hold more dependency evidence.")
    return out.select(
        "relative_path",
        F.when(failed, "failed").when(part, "partially parsed").otherwise("parsed").alias("status"),
        F.concat_ws(" ", more, none).alias("message"),
        "component_count",
    )
