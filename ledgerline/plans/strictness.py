"""Registered queries of the strict readers: JSON with its limits, XML as events, the nested
trees of old lock files, and license expressions. Inputs are made from whole tables so that each row has its
own text; what each must give follows from the same columns in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spdx
from ..operators import parse, strict_json
from ..shared import saved, spread
from .formats import MARKS

#: Of event_id % n: what is done to a sound text, as (Spark expression, SQL code).
#: X is the event's props as JSON, S a document-like text as a JSON string, K the number.
JSON_KINDS: tuple[tuple[str, str], ...] = (
    ("""X""", "''"),
    ("""concat('{"a":', X, ',"b":[', S, ',', K, ']}')""", "''"),
    ("""concat('{"a":1,"b":', S, ',"a":', X, '}')""", "'duplicate'"),
    ("""concat('{"caf\\\\u00e9":', X, ',"café":', K, '}')""", "'duplicate'"),
    ("""concat(repeat('[', D), X, repeat(']', D))""", "CASE WHEN {d} + 1 > 128 THEN 'depth' ELSE '' END"),
    ("""concat(repeat('{"k":', D), S, repeat('}', D))""", "CASE WHEN {d} > 128 THEN 'depth' ELSE '' END"),
    ("""concat('{"s":"\\\\ud83d\\\\ude', lpad(hex(128 + K % 64), 2, '0'), '","t":', S, '}')""", "''"),
    ("""concat('{"s":"\\\\ud83d', K, '"}')""", "'surrogate'"),
    ("""concat('{"s":"\\\\ude80 ', K, '","t":', X, '}')""", "'surrogate'"),
    ("""concat('{"s":"\\\\\\\\ud83d', K, '"}')""", "''"),
    ("""concat('{"s":"\\\\u00z', K, '"}')""", "'escape'"),
    ("""concat(X, ' ', S)""", "'syntax'"),
    ("""concat('[', K, ',', X, ',]')""", "'syntax'"),
    ("""concat('{"a":', X, ' /* ', K, ' */}')""", "'syntax'"),
    ("""concat('\\ufeff', X)""", "'syntax'"),
    ("""concat('{"n":[', K, ',-', K, '.5,', K, 'e+3,0', K, ']}')""", "'syntax'"),
    ("""concat('{"n":[', K, ',-', K, '.5,', K, 'e+3]}')""", "''"),
    ("""left(concat('{"a":', X, ',"b":', S, '}'), 12 + cast(K % 9 as int))""", "'syntax'"),
    ("""concat('{"a":"tab\\t', K, '"}')""", "'syntax'"),
    ("""repeat(' ', cast(K % 7 as int))""", "'empty'"),
    ("""concat('{\n  "a": ', X, ',\n\t"b": [\r\n', S, ', ', K, '\n]\n}\n')""", "''"),
)


def json_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on a text per event, and per document, as a JSON string in an object."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props", "event_type")
    named = events.select(
        "event_id", F.col("props").alias("X"), F.to_json(F.array(F.concat("event_type", F.lit(' "\\ '), "event_id"))).alias("S"),
        F.col("event_id").cast("string").alias("K"), (F.lit(100) + F.col("event_id") % 60).cast("int").alias("D"),
    )
    text = F.lit(None).cast("string")
    for n, (made, _) in enumerate(JSON_KINDS):
        text = F.when(F.col("event_id") % len(JSON_KINDS) == n, F.expr(made)).otherwise(text)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = documents.select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"),
        # two in three are sound; the others have no end, or a raw line feed behind them in a string
        F.concat(F.to_json(F.struct("doc_id", "text")), F.when(F.col("doc_id") % 3 == 1, "}").when(F.col("doc_id") % 3 == 2, ' "').otherwise("")).alias("content"),
    )
    rows = named.select(F.lit("event").alias("source"), F.col("event_id").alias("id"), text.alias("content")).unionByName(whole)
    return rows.select("source", "id", strict_json.json_error(F.col("content")).alias("error"))


def _json_checks_sql() -> str:
    n = len(JSON_KINDS)
    cases = " ".join(f"WHEN {k} THEN {code.format(d='(100 + event_id % 60)')}" for k, (_, code) in enumerate(JSON_KINDS))
    return f"""SELECT 'event' AS source, event_id AS id, CASE event_id % {n} {cases} END AS error FROM events
UNION ALL SELECT 'document', doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'syntax' END FROM documents"""


#: parser, content, and the rows (name, version, scope) or None where the file must fail;
#: $K is the part's key, $S its size, $N its name, in XML and in the rows alike.
XML_KINDS: tuple[tuple[str, str, list[tuple[str, str, str]] | None], ...] = (
    (
        "maven-pom-xml",
        "<project><dependencies><dependency><artifactId><![CDATA[$N<&>$K]]></artifactId><version>1.$S</version></dependency></dependencies></project>",
        [("$N<&>$K", "1.$S", "runtime")],
    ),
    (
        "maven-pom-xml",
        '<?xml version="1.0"?><m:project xmlns:m="u"><m:x><m:dependency><m:artifactId>$N&amp;&#x41;&#66;</m:artifactId><m:version> $S </m:version><m:scope>TEST</m:scope></m:dependency></m:x></m:project>',
        [("$N&AB", "$S", "development")],
    ),
    (
        "maven-pom-xml",
        "<project><description><![CDATA[<dependency><artifactId>no</artifactId></dependency>]]></description><dependency><artifactId>a<!-- c -->$K</artifactId><optional> True</optional></dependency></project>",
        [("a$K", "", "optional")],
    ),
    (
        "maven-pom-xml",
        "<project><artifactId>app$K</artifactId><parent><groupId>g</groupId><version>9.$S</version></parent><Organization><name>no</name></Organization><licenses><license><name>MIT</name></license></licenses>"
        "<dependencies><dependency><artifactId>d$K</artifactId><scope>provided</scope><exclusions><dependency><artifactId>no</artifactId></dependency></exclusions></dependency></dependencies></project>",
        [("app$K", "9.$S", "project"), ("d$K", "", "provided")],
    ),
    ("maven-pom-xml", "<project><dependencies><dependency><artifactId>a$K</artifactId></dependency></dependencies>", None),
    ("maven-pom-xml", "<!DOCTYPE project [<!ENTITY e '$K'>]><project><dependency><artifactId>&e;</artifactId></dependency></project>", None),
    ("maven-pom-xml", "<project><dependency><artifactId>&undefined;$K</artifactId></dependency></project>", None),
    (
        "msbuild-package-reference",
        """<Project><ItemGroup Condition="'$(X)' > '$K'"><PackageReference Include="P.$K" Condition="1 > $S"><VERSION>[$S.0]</VERSION></PackageReference><packagereference Update='U&quot;$K' Version="$S" /></ItemGroup></Project>""",
        [("P.$K", "[$S.0]", "runtime"), ('U"$K', "$S", "runtime")],
    ),
    ("msbuild-central-package-xml", "<Project><PackageVersion include='no' Include='C$K'/><PackageVersion Include='D$K' Version='$S'></PackageVersion></Project>", [("C$K", "", "runtime"), ("D$K", "$S", "runtime")]),
    (
        "lazarus-project-xml",
        "<C><RequiredPackages><Item1><PackageName Value='$N'/></Item1><Group><Item2><Name> N$K </Name></Item2></Group><item3><PackageName Value='no'/></item3></RequiredPackages><Item4><PackageName Value='no'/></Item4></C>",
        [("$N", "", "build"), ("N$K", "", "build")],
    ),
    ("lazarus-project-xml", "<C><RequiredPackages><Item1 a='1' a='2'><PackageName Value='$K'/></Item1></RequiredPackages></C>", None),
)


def filled(template: str) -> Column:
    of = {"$K": F.col("p_partkey").cast("string"), "$S": F.col("p_size").cast("string"), "$N": F.col("p_name")}
    return F.concat(F.lit(""), *[of[x] if x in of else F.lit(x) for x in MARKS.split(template) if x])


def filled_sql(template: str) -> str:
    of = {"$K": "CAST(p_partkey AS VARCHAR)", "$S": "CAST(p_size AS VARCHAR)", "$N": "p_name"}
    return " || ".join(["''", *[of.get(x) or "'" + x.replace("'", "''") + "'" for x in MARKS.split(template) if x]])


def xml_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and status of an XML manifest per part: CDATA, references, prefixes, '>' in
    attributes, comments in names, and what must fail."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name"))
    kind = F.col("p_partkey") % len(XML_KINDS)
    parser, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (p, template, _) in enumerate(XML_KINDS):
        parser, content = F.when(kind == n, p).otherwise(parser), F.when(kind == n, filled(template)).otherwise(content)
    files = part.select(F.col("p_partkey").cast("string").alias("relative_path"), parser.alias("parser"), content.alias("content"))
    rows = saved(parse.components(files, sorted({p for p, *_ in XML_KINDS})), "rows")  # to be counted, and listed
    done = parse.outcomes(files, rows).select("relative_path", "status")
    return done.join(rows.select("relative_path", "name", "version", "dependency_scope"), "relative_path", "left")


def _xml_checks_sql() -> str:
    out = []
    for n, (_, _, rows) in enumerate(XML_KINDS):
        for row in rows or [None]:
            values = ["'failed'", "NULL", "NULL", "NULL"] if row is None else ["'parsed'", *map(filled_sql, row)]
            columns = ", ".join(f"{v} AS {c}" for v, c in zip(values, ("status", "name", "version", "dependency_scope"), strict=True))
            out.append(f"SELECT CAST(p_partkey AS VARCHAR) AS relative_path, {columns} FROM part WHERE p_partkey % {len(XML_KINDS)} = {n}")
    return "\nUNION ALL ".join(out)


#: Nesting of chains, entries of a part on one level, and keys of a file.
CHAIN, WIDE, KEYS = 40, 256, 500


def _lock_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_brand"))
    depth = (F.col("p_partkey") % CHAIN + 1).cast("int")
    name = lambda i: F.concat(F.lit('{"c'), "p_partkey", F.lit("-"), i, F.lit('": {"version": "1.'), i, F.lit("."), "p_size", F.lit('"'))
    opened = F.array_join(F.transform(F.sequence(F.lit(1), depth), name), ', "dependencies": ')
    chains = part.select(F.concat(F.lit("chain/"), "p_partkey").alias("relative_path"), F.concat(F.lit('{"dependencies": '), opened, F.repeat(F.lit("}}"), depth), F.lit("}")).alias("content"))
    # parts are dealt by their file, and texts made where they are judged
    path = F.concat(F.lit("wide/"), "p_brand", F.lit("/"), F.floor(F.col("p_partkey") / KEYS))
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(path.alias("relative_path"), "p_partkey", "p_size"), "relative_path")
    entry = lambda p: lambda j: F.concat(F.lit('"w'), p["p_partkey"], F.lit("-"), j, F.lit('": {"version": "'), j, F.lit("."), p["p_size"], F.lit('.0"}'))
    own = lambda p: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(WIDE)), entry(p)), ", ")
    grouped = parts.groupBy("relative_path").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("parts"))
    wide = grouped.select("relative_path", F.concat(F.lit('{"dependencies": {'), F.array_join(F.transform("parts", own), ", "), F.lit("}}")).alias("content"))
    return chains.unionByName(wide).withColumn("parser", F.lit("package-lock-json"))


def lock_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of lock files that nest 1 to 40 levels deep, or hold thousands of entries on
    one: per file their number, and sums that tell their order and versions."""
    files = _lock_files(spark, sf_dir)
    rows = parse.components(files, ["package-lock-json"])
    number = F.substring_index("name", "-", -1).cast("long")
    # distinct places are the bits of 64 at a time, so that few rows are shuffled
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    words = rows.groupBy("relative_path", F.floor(F.col("place") / 64).alias("word")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_or(bit).alias("places"),
        F.max("place").alias("last_place"),
        F.sum(F.col("place") * number).alias("places_by_number"),
        F.sum(F.length("version")).alias("version_chars"),
        F.max("package_url").alias("last_url"),
    )
    return words.groupBy("relative_path").agg(
        F.sum("n").alias("n"),
        F.sum(F.bit_count("places")).alias("n_places"),
        F.max("last_place").alias("last_place"),
        F.sum("places_by_number").alias("places_by_number"),
        F.sum("version_chars").alias("version_chars"),
        F.max("last_url").alias("last_url"),
    )


LOCK_TREES_SQL = f"""WITH e AS (
  SELECT 'chain/' || p_partkey AS relative_path, i AS number, i - 1 AS place, '1.' || i || '.' || p_size AS version, 'c' || p_partkey || '-' || i AS name
  FROM (SELECT *, unnest(range(1, p_partkey % {CHAIN} + 2)) AS i FROM part)
  UNION ALL SELECT path, j, row_number() OVER (PARTITION BY path ORDER BY p_partkey, j) - 1, j || '.' || p_size || '.0', 'w' || p_partkey || '-' || j
  FROM (SELECT *, 'wide/' || p_brand || '/' || (p_partkey // {KEYS}) AS path, unnest(range(1, {WIDE + 1})) AS j FROM part))
SELECT relative_path, count(*) AS n, count(*) AS n_places, max(place) AS last_place, CAST(sum(place * number) AS BIGINT) AS places_by_number,
  CAST(sum(length(version)) AS BIGINT) AS version_chars, max('pkg:npm/' || name || '@' || version) AS last_url FROM e GROUP BY relative_path"""

#: Operands and exceptions of license expressions, and their shapes: A and B operands, E an
#: exception, O an operator, D a depth and M a number, all by the part.
OPERANDS = (
    "MIT", "Apache-2.0", "mit", "GPL-2.0-only", "LicenseRef-$K", "BSD-3-Clause+", "Licence-$K", "ISC", "DocumentRef-d$S:LicenseRef-$N", "Zlib", "GPL-2.0-or-later+", "LicenseRef-$S+",
    "DocumentRef-$K:LicenseRef-x.$S", "AND", "MIT-0",
)
EXCEPTIONS = ("Classpath-exception-2.0", "LLVM-exception", "Exception-$K", "GCC-exception-3.1")
SHAPES = (
    "A", "A O B", "(A O B) O A", "A O (B O (A))", "A WITH E", "(A) WITH E", "A O", "(A O B", "A O B)", "A B", "()", "A  O   B", " A O B ", "(A)O B", "A O(B)", "A WITH A", "A WITH E O B",
    "A O B WITH E O (A WITH E)", "OPEN A CLOSE", "A MANY", "A\tO B", "A +", "A O O B", "", "( A )", "A WITH E WITH E", "O A", "(A WITH E) O B",
)


def picked(values: tuple[str, ...], by: Column, fill: Callable | None = None) -> Column:
    out = F.lit(None).cast("string")
    for n, v in enumerate(values):
        out = F.when(by % len(values) == n, (fill or filled)(v)).otherwise(out)
    return out


def license_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression per part, of its own names and shape, and whether it is valid: by the
    built-in names, and by the same names as a table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name")
    key = F.col("p_partkey")
    rows = part.select(
        "p_partkey", picked(OPERANDS, F.col("p_size")).alias("a"), picked(OPERANDS, F.floor(key / 5)).alias("b"), picked(EXCEPTIONS, key).alias("e"),
        F.when(key % 2 == 0, "AND").otherwise("OR").alias("o"), (28 + key % 10).cast("int").alias("d"), (120 + key % 16).cast("int").alias("m"), picked(SHAPES, F.floor(key / 3), F.lit).alias("s"),
    )
    text = F.regexp_replace("s", r"\bE\b", "\x10")
    text = F.replace(text, F.lit("OPEN"), F.repeat(F.lit("("), F.col("d")))
    text = F.replace(F.replace(text, F.lit("CLOSE"), F.repeat(F.lit(")"), F.col("d"))), F.lit("MANY"), F.repeat(F.lit("O B "), F.col("m")))
    for mark, code in (("A", "\x11"), ("B", "\x12"), ("O", "\x13")):
        text = F.regexp_replace(text, rf"\b{mark}\b", code)
    for code, name in (("\x10", "e"), ("\x11", "a"), ("\x12", "b"), ("\x13", "o")):
        text = F.replace(text, F.lit(code), F.col(name))
    rows = rows.select("p_partkey", text.alias("expression"))
    names = [(n, False) for n in spdx.LICENSES] + [(n, True) for n in spdx.EXCEPTIONS]
    table = spark.createDataFrame(names, "name string, is_exception boolean")
    return spdx.valid_expressions(rows, "expression", table).withColumn("by_list", spdx.is_valid_expression(F.col("expression")))


def _names(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _license_sql() -> str:
    pick = lambda values, by: "CASE " + " ".join(f"WHEN {by} % {len(values)} = {n} THEN {filled_sql(v)}" for n, v in enumerate(values)) + " END"
    shape = "CASE " + " ".join(f"WHEN (p_partkey // 3) % {len(SHAPES)} = {n} THEN '{v}'".replace("\t", "' || chr(9) || '") for n, v in enumerate(SHAPES)) + " END"
    word = lambda x, mark, code: f"regexp_replace({x}, '\\b{mark}\\b', chr({code}), 'g')"
    s = f"replace(replace(replace({word('s', 'E', 16)}, 'OPEN', repeat('(', d)), 'CLOSE', repeat(')', d)), 'MANY', repeat('O B ', m))"
    for mark, code in (("A", 17), ("B", 18), ("O", 19)):
        s = word(s, mark, code)
    for code, name in ((16, "e"), (17, "a"), (18, "b"), (19, "o")):
        s = f"replace({s}, chr({code}), {name})"
    kind = f"""CASE WHEN t IN ('(', ')', chr(2), chr(3)) THEN t WHEN regexp_replace(t, '[+]$', '') IN {_names(spdx.LICENSES)} THEN 'l' WHEN t IN {_names(spdx.EXCEPTIONS)} THEN 'e'
    WHEN regexp_full_match(t, '(DocumentRef-[A-Za-z0-9.-]+:)?LicenseRef-[A-Za-z0-9.-]+') THEN 'x' ELSE '?' END"""
    reduced = "replace(replace(replace(s, 'l' || chr(3) || 'e', 'x'), '(x)', 'x'), 'x' || chr(2) || 'x', 'x')"
    return f"""WITH RECURSIVE g AS (SELECT p_partkey, {pick(OPERANDS, 'p_size')} AS a, {pick(OPERANDS, '(p_partkey // 5)')} AS b, {pick(EXCEPTIONS, 'p_partkey')} AS e,
    CASE WHEN p_partkey % 2 = 0 THEN 'AND' ELSE 'OR' END AS o, 28 + p_partkey % 10 AS d, 120 + p_partkey % 16 AS m, {shape} AS s FROM part),
t AS (SELECT p_partkey, {s} AS expression FROM g),
c AS (SELECT p_partkey, expression, trim(expression) AS x, regexp_extract_all(regexp_replace(regexp_replace(trim(expression), ' +(AND|OR) ', chr(2), 'g'), ' +WITH ', chr(3), 'g'), '[()\x02\x03]|[A-Za-z0-9.:-]+[+]?|[^ ]') AS ts FROM t),
k AS (SELECT p_partkey, expression, list_transform(ts, lambda t: {kind}) AS ks,
    strlen(x) BETWEEN 1 AND 4096 AND len(ts) + len(string_split(expression, '+')) - 1 <= 256 AND NOT regexp_matches(expression, '[\x00-\x1f\x7f]') AS sized FROM c),
depth AS (SELECT p_partkey, max(n) AS most FROM (SELECT p_partkey, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS n
    FROM (SELECT p_partkey, unnest(ks) AS c, generate_subscripts(ks, 1) AS i FROM k)) GROUP BY p_partkey),
r AS (SELECT p_partkey, replace(replace(array_to_string(ks, ''), 'l' || chr(3) || 'e', 'x'), 'l', 'x') AS s, 0 AS n FROM k
  UNION ALL SELECT p_partkey, {reduced}, n + 1 FROM r WHERE s <> {reduced}),
last AS (SELECT p_partkey, arg_max(s, n) AS s FROM r GROUP BY p_partkey)
SELECT p_partkey, expression, sized AND last.s = 'x' AND coalesce(most, 0) <= 32 AS valid, valid AS by_list FROM k JOIN last USING (p_partkey) LEFT JOIN depth USING (p_partkey)"""


QUERIES = {f.__name__: f for f in (json_checks, xml_checks, lock_trees, license_expressions)}
ORACLES = {"json_checks": _json_checks_sql(), "xml_checks": _xml_checks_sql(), "lock_trees": LOCK_TREES_SQL, "license_expressions": _license_sql()}
