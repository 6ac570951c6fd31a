"""License expressions: AND, OR, WITH, parentheses, '+', and license references.

An expression is a list of tokens, each of one class. A pushdown parser runs over the
classes: parentheses are all that it stacks, so its stack is their number. Names are
looked up in a short built-in list, or joined with a table of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim

MAX_BYTES, MAX_TOKENS, MAX_DEPTH = 4096, 256, 32
#: Identifiers of common licenses and exceptions in the public SPDX list. A
#: caller with a longer list passes it.
LICENSES = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0",
    "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "BlueOak-1.0.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "CDDL-1.0", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0",
    "MPL-1.1", "MPL-2.0", "MS-PL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "OpenSSL", "PSF-2.0", "PostgreSQL", "Python-2.0",
    "Ruby", "SSPL-1.0", "UPL-1.0", "Unicode-DFS-2016", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "ZPL-2.1", "Zlib",
)
EXCEPTIONS = (
    "Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-2.0",
    "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "OpenSSL-exception", "Qt-GPL-exception-1.0",
)
IDENTIFIER = r"[A-Za-z0-9.:\-]+"
#: Operators stand between spaces; else their names are identifiers, and unknown ones. A
#: '+' belongs to the identifier before it.
TOKEN = rf"( +(?:AND|OR|WITH)(?= )|[()]|{IDENTIFIER}\+?|[^ ])"
REFERENCE = r"^(?:DocumentRef-[A-Za-z0-9.\-]+:)?LicenseRef-[A-Za-z0-9.\-]+$"
#: Classes of tokens: parentheses, AND or OR, WITH, license, exception, reference, other.
OPENS, CLOSES, JOINS, WITH, LICENSE, EXCEPTION, LICENSE_REFERENCE, OTHER = "()&wler?"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(trim(text), F.lit(TOKEN), F.lit(1))


def bounded(text: Column) -> Column:
    """Whether an expression is one by its size and characters."""
    n = F.size(tokens(text)) + F.length(text) - F.length(F.replace(text, F.lit("+"), F.lit("")))
    return (trim(text) != "") & (F.octet_length(trim(text)) <= MAX_BYTES) & (n <= MAX_TOKENS) & ~text.rlike(r"[\x00-\x1f\x7f]")


def _class(token: Column, is_license: Column, is_exception: Column) -> Column:
    bare = F.regexp_replace(token, r"\+$", "")
    plain = token == bare
    return (
        F.when(token.isin("(", ")"), token)
        .when(trim(token).isin("AND", "OR") & token.startswith(" "), JOINS)
        .when((trim(token) == "WITH") & token.startswith(" "), WITH)
        .when(is_license, LICENSE)
        .when(plain & token.rlike(REFERENCE), LICENSE_REFERENCE)
        .when(plain & is_exception, EXCEPTION)
        .otherwise(OTHER)
    )


def accepts(classes: Column) -> Column:
    """Whether an array of classes is a whole expression. The parser wants an operand (o), has
    read a license (l), which alone WITH may follow, or another operand (d), wants an
    exception (e), or has failed (x)."""
    start = F.struct(F.lit("o").alias("state"), F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        s = acc["state"]
        after = s.isin("l", "d")
        state = (
            F.when((s == "o") & (c == OPENS), "o")
            .when((s == "o") & (c == LICENSE), "l")
            .when((s == "o") & (c == LICENSE_REFERENCE), "d")
            .when(after & (c == CLOSES) & (acc["open"] > 0), "d")
            .when(after & (c == JOINS), "o")
            .when((s == "l") & (c == WITH), "e")
            .when((s == "e") & (c == EXCEPTION), "d")
            .otherwise("x")
        )
        held = acc["open"] + F.when(c == OPENS, 1).when(c == CLOSES, -1).otherwise(0)
        return F.struct(state.alias("state"), held.alias("open"), F.greatest(acc["most"], held).alias("most"))

    return F.aggregate(classes, start, step, lambda acc: acc["state"].isin("l", "d") & (acc["open"] == 0) & (acc["most"] <= MAX_DEPTH))


def is_valid_expression(text: Column, licenses: tuple[str, ...] = LICENSES, exceptions: tuple[str, ...] = EXCEPTIONS) -> Column:
    named = lambda t, names: F.regexp_replace(t, r"\+$", "").isin(*names)
    classes = F.transform(tokens(text), lambda t: _class(t, named(t, licenses), t.isin(*exceptions)))
    return F.coalesce(bounded(text) & accepts(classes), F.lit(False))


def valid_expressions(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with one more column, valid, by a table of names (name, is_exception) of any
    length. Each distinct expression is parsed once; a null one is not valid."""
    each = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_text")).distinct()
    short = each.where(bounded(F.col("_text")))  # so no list of tokens is long
    token = short.select("_text", F.posexplode(tokens(F.col("_text"))).alias("_at", "_token")).withColumn("_name", F.regexp_replace("_token", r"\+$", ""))
    known = names.groupBy(F.col("name").alias("_name")).agg(F.bool_or("is_exception").alias("_e"), F.bool_or(~F.col("is_exception")).alias("_l"))
    found = token.join(known, "_name", "left")
    no = F.lit(False)
    found = found.withColumn("_class", _class(F.col("_token"), F.coalesce("_l", no), F.coalesce("_e", no)))
    parsed = found.groupBy("_text").agg(accepts(F.array_sort(F.collect_list(F.struct("_at", "_class"))).getField("_class")).alias("valid"))
    out = rows.join(parsed, F.col(column) == F.col("_text"), "left").drop("_text")
    return out.withColumn("valid", F.coalesce("valid", no))
