"""Strict JSON: why a text is not taken, as one column expression.

Strings are cut out of the text first, so that what is left shows its structure; counts,
nesting and escapes are then read from it by Spark's own functions, before and apart from
the parse. Nothing goes to a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits on nesting, values and keys, and tokens.
MAX_DEPTH, MAX_NODES, MAX_TOKENS = 128, 262_144, 1_048_576
#: Bytes of a manifest.
MAX_BYTES = 32 << 20

STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
#: The same without control characters.
PLAIN_STRING = r'"[^"\\\x00-\x1f]*+(?:\\[^\x00-\x1f][^"\\\x00-\x1f]*+)*+"'
ATOM = r'[^\s"{}\[\],:]+'
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: What may follow a value, and stand before one.
VALUE = rf'(?:"|true|false|null|{NUMBER})'


def _nesting(brackets: Column) -> Column:
    """(now, most, closed, crossed) over an array of brackets: whether the outermost one
    was closed before the last bracket, and whether one was closed by the other kind. A dot
    is a bracket that is closed at once."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("most"), F.lit(False).alias("early"), F.lit(False).alias("crossed"))

    def step(acc: Column, c: Column) -> Column:
        opens = c.isin("{", "[")
        opened = F.concat(F.when(c == "{", "}").otherwise("]"), acc["open"])
        # a document too deep fails by that; the rest of its stack is not needed
        kept = F.when((acc["most"] > MAX_DEPTH) | (c == "."), acc["open"]).when(opens, opened).otherwise(F.substring(acc["open"], 2, MAX_DEPTH + 2))
        return F.struct(
            kept.alias("open"),
            F.greatest(acc["most"], F.length(kept) + (c == ".").cast("int")).alias("most"),
            (acc["early"] | ((acc["most"] > 0) & (acc["open"] == ""))).alias("early"),
            (acc["crossed"] | (~opens & (c != ".") & (F.substring(acc["open"], 1, 1) != c))).alias("crossed"),
        )

    return F.aggregate(brackets, start, step)


def json_error(content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a text is no strict JSON; '' if it is. In the order of the tests: empty, size,
    escape (a \\u without four hex digits), surrogate (one without its other half), tokens,
    nodes, depth, syntax (whatever the grammar forbids: comments, spare commas, text behind
    the value, a byte order mark), duplicate (a member twice in one object, however it is
    escaped). Null is empty. Texts come decoded, so their bytes were UTF-8."""
    text = F.coalesce(content.cast("string"), F.lit(""))
    # each escape but \u and what it escapes becomes one blank, so '\\ud800' is none
    escapes = F.when(text.contains("\\u"), F.regexp_replace(text, r"\\[^u]", " ")).otherwise("")
    parts = F.struct(text.alias("text"), F.regexp_replace(text, STRING, '"').alias("bare"), escapes.alias("escapes"))
    return _let(parts, lambda x: _judged(x["text"], x["bare"], x["escapes"], max_bytes))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _judged(text: Column, bare: Column, escapes: Column, max_bytes: int) -> Column:
    alone = F.regexp_replace(escapes, r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}", " ")
    # no more of them than bytes, so that they are counted in large documents alone
    over = lambda pattern, most: (F.octet_length(bare) > most) & (F.regexp_count(bare, F.lit(pattern)) > most)
    # f is bare with whole members folded
    grammar = lambda f: (
        bare.rlike(rf"^[\x20\t\n\r]*[{{\[]|^[\x20\t\n\r]*{VALUE}[\x20\t\n\r]*\z")
        # white space that JSON doesn't know; other characters are in atoms, see below
        & ~f.contains("\x0b") & ~f.contains("\x0c")
        # nothing between commas and colons, or before and behind them
        & ~f.rlike(r"[,:\[{][\x20\t\n\r]*,|[,:{\[][\x20\t\n\r]*:|[,:][\x20\t\n\r]*[}\]]|[,:][\x20\t\n\r]*\z")
        # two values side by side
        & ~f.rlike(r"[}\]\"a-z0-9A-Z][\x20\t\n\r]*[{\[\"]|[}\]\"][\x20\t\n\r]*[a-z0-9A-Z+.\-]|[a-z0-9A-Z.][\x20\t\n\r]+[a-z0-9A-Z+.\-]")
        # an atom that is no number or word of the grammar
        & ~f.rlike(rf"(?<![^\x20\t\n\r\"{{}}\[\],:])(?!{VALUE}(?![^\x20\t\n\r{{}}\[\],:])){ATOM}")
        # control characters in strings, and escapes that don't exist
        & (~text.rlike(r"[\x00-\x1f]") | (F.regexp_replace(text, PLAIN_STRING, '"') == bare))
        & (~text.contains("\\") | ~F.regexp_replace(text, r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})', "").contains("\\"))
    )
    whole = lambda n: (n["open"] == "") & ~n["early"] & ~n["crossed"]
    parsed = F.when(F.try_parse_json(text).isNotNull(), "").otherwise(F.when(F.get_json_object(text, "$").isNull(), "syntax").otherwise("duplicate"))
    nested = lambda n, f: F.when(n["most"] > MAX_DEPTH, "depth").when(~grammar(f) | ~whole(n), "syntax").otherwise(parsed)
    return (
        F.when(bare.rlike(r"^[\x20\t\n\r]*\z"), "empty")
        .when(F.octet_length(text) > max_bytes, "size")
        .when(escapes.rlike(r"\\u(?![0-9A-Fa-f]{4})"), "escape")
        .when(alone.rlike(r"\\u[dD][89a-fA-F]"), "surrogate")
        .when(over(rf'["{{}}\[\],:]|{ATOM}', MAX_TOKENS), "tokens")
        .when(over(rf'["{{\[]|{ATOM}', MAX_NODES), "nodes")
        .otherwise(_let(F.struct(_nesting(_brackets(bare)).alias("n"), _folded(bare).alias("f")), lambda x: nested(x["n"], x["f"])))
    )


def _brackets(bare: Column) -> Column:
    """The brackets of a text; those closed at once are dots, and of a run of dots two stand
    for all, so that wide documents have few."""
    text = F.regexp_replace(F.regexp_replace(bare, r"[^{}\[\]]+", ""), r"\{\}|\[\]", ".")
    return F.regexp_extract_all(F.regexp_replace(text, r"\.{3,}", ".."), F.lit(r"([{}\[\].])"), F.lit(1))


def _folded(bare: Column) -> Column:
    """A text whose neighbours are such as bare's, but shorter: members and items that are
    strings are told as one string, and so is an object of one. The grammar asks but which
    token may stand beside which; a string is beside a token what a closed object is."""
    out = bare
    for whole, one in ((", ", ","), (": ", ":"), ('":"', '"'), ('{"}', '"'), ('":"', '"'), ('","', '"'), ('","', '"'), ('","', '"')):
        out = F.replace(out, F.lit(whole), F.lit(one))
    return out
