"""The strict JSON verdict and the XML event reader, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import parse, xml_events
from ledgerline.operators.strict_json import json_error

U = "\\u"
CASES = [
    ('{"a":1}', ''),
    ('[]', ''),
    ('"x"', ''),
    (' 12 ', ''),
    ('{"a":[1,2,{"b":null}],"c":"\\n\\u00e9"}', ''),
    ('', 'empty'),
    ('  ', 'empty'),
    ('{"x":"\\ud800"}', 'surrogate'),
    ('{"x":"\\ud800\\u0041"}', 'surrogate'),
    ('{"x":"\\udc00"}', 'surrogate'),
    ('{"x":"\\ud83d\\ude80"}', ''),
    ('{"x":"\\\\ud800"}', ''),
    ('{"x":"\\u12g4"}', 'escape'),
    ('{"x":1} trailing', 'syntax'),
    ('{"x":1,//c\n"y":2}', 'syntax'),
    ('{"x":1,}', 'syntax'),
    ('[1,]', 'syntax'),
    ('[,1]', 'syntax'),
    ('{"x":1,"x":2}', 'duplicate'),
    ('{"é":1,"\\u00e9":2}', 'duplicate'),
    ('{"x":1}{"y":2}', 'syntax'),
    ('[1][2]', 'syntax'),
    ('{"x":1]', 'syntax'),
    ('{"x" 1}', 'syntax'),
    ('{x:1}', 'syntax'),
    ("{'x':1}", 'syntax'),
    ('{"x":01}', 'syntax'),
    ('{"x":1.}', 'syntax'),
    ('{"x":+1}', 'syntax'),
    ('{"x":NaN}', 'syntax'),
    ('{"x":tru}', 'syntax'),
    ('{"x":"a\nb"}', 'syntax'),
    ('{"x":"\\q"}', 'syntax'),
    ('\ufeff{"x":1}', 'syntax'),
    ('{"a":1,"b":{"a":1}}', ''),
    ('{"x":1', 'syntax'),
    ('"a', 'syntax'),
    ('[1 2]', 'syntax'),
    ('{"a":"b" "c":1}', 'syntax'),
    ('{1:2}', 'syntax'),
    ('{"a":}', 'syntax'),
    ('{:1}', 'syntax'),
    ('[1:2]', 'syntax'),
    ('{"a",1}', 'syntax'),
    ('{"a"}', 'syntax'),
    ('-', 'syntax'),
    ('[-1.5e+3,0,-0]', ''),
    ('[1e5]', ''),
    ('[.5]', 'syntax'),
    ('{"a":"x\\"y\\\\"}', ''),
    ('nul', 'syntax'),
    ('null', ''),
    ('{"\\u0000key":"line\\u000aend"}', ''),
    ('{"a":1}\x00', 'syntax'),
    ('\x0b{"a":1}', 'syntax'),
    ('{"x":1}}', 'syntax'),
    (']', 'syntax'),
    ('{"a":{},"b":[]}', ''),
    ('{"a":"\u2028"}', ''),
    ('{"a":1\xa0}', 'syntax'),
    (json.dumps({"a": [1, "x", {"b": None, "c": ["d", "e\\n"]}], "f": {}}, indent=2) + "\n", ""),
    ('{"a": "x",\r\n\t"b": "y"}', ""),
    ('{"a": "x", "b": "tab\there"}', "syntax"),
    ('{"a": "x", "b": "escaped\\\nbreak"}', "syntax"),
    ("[" * 128 + "]" * 128, ""),
    ("[" * 129 + "]" * 129, "depth"),
    ('{"a":' * 128 + "1" + "}" * 128, ""),
    ('{"a":' * 129 + "1" + "}" * 129, "depth"),
    ("[" + ",".join(["0"] * 262_143) + "]", ""),
    ("[" + ",".join(["0"] * 262_144) + "]", "nodes"),
    ("," * 1_048_577, "tokens"),
    ("," * 1_048_576, "syntax"),
    ('{"k":"' + "a" * 3_000_000 + '"}', ""),
    ('{"k":"' + "\\\\" * 1_000_000 + '"}', ""),
    (None, "empty"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    got = {r["i"]: r["e"] for r in df.select("i", json_error(F.col("c")).alias("e")).collect()}
    assert [(c if c is None else c[:80], got[i]) for i, (c, _) in enumerate(CASES)] == [(c if c is None else c[:80], w) for c, w in CASES]


def test_size_limit(spark):
    df = spark.createDataFrame([('{"a":"é"}',)], "c string")
    errors = df.select(json_error(F.col("c"), 10).alias("a"), json_error(F.col("c"), 9).alias("b")).first()
    assert tuple(errors) == ("", "size")


def elements(text):
    return [(r[2], r[4], r[5]) for r in sorted(xml_events.read_elements(text))]


def test_elements_of_a_document():
    got = elements("<?xml version='1.0'?><p:A xmlns:p='u' x='1&lt;2'>a<B/>&#x41;<b>c<![CDATA[<d>]]></b><!-- e --><B>f</B></p:A>")
    assert got == [
        ("A[1]", {"xmlns:p": "u", "x": "1<2"}, "aAc<d>f"),
        ("A[1]/B[1]", {}, ""),
        ("A[1]/b[1]", {}, "c<d>"),
        ("A[1]/B[2]", {}, "f"),
    ]
    folded = [r[3] for r in sorted(xml_events.read_elements("<A><B/><b/></A>"))]
    assert folded == ["a[1]", "a[1]/b[1]", "a[1]/b[2]"]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        (None, "empty"), (" ", "empty"), ("<a>", "malformed"), ("<a/><b/>", "malformed"), ("text", "malformed"), ("<a x='1' x='2'/>", "malformed"),
        ("<!DOCTYPE a><a/>", "doctype"), ("<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>", "doctype"), ("<a>&b;</a>", "malformed"), ("<a>&#0;</a>", "malformed"),
        ("<a>" * 256 + "</a>" * 256, ""), ("<a>" * 257 + "</a>" * 257, "depth"), ("<a>" + "x" * (16 << 20) + "</a>", "size"), ("<a b='" + ">" * 100 + "'/>", ""),
    ],
)
def test_refused_documents(text, code):
    try:
        found = len(list(xml_events.read_elements(text)))
        assert code == "" and found
    except xml_events.Refused as e:
        assert str(e) == code


def test_long_texts_are_null_and_files_fail_alone(spark):
    long = "<a><b>" + "x" * 70_000 + "</b><c>y</c></a>"
    files = spark.createDataFrame([("1", long), ("2", "<a><b>"), ("3", None), ("4", "<r>z</r>")], "relative_path string, content string")
    got = {(r["relative_path"], r["path"]): r["text"] for r in xml_events.xml_events(files).collect()}
    assert got == {("1", "a[1]"): None, ("1", "a[1]/b[1]"): None, ("1", "a[1]/c[1]"): "y", ("4", "r[1]"): "z"}
    assert xml_events.xml_events(files.limit(0)).collect() == []


def test_lock_trees_keep_their_order_and_fail_alone(spark):
    deep = '{"dependencies": ' + "".join(f'{{"d{i}": {{"version": "1.0.{i}", "dependencies": ' for i in range(60)) + "{}" + "}}" * 60 + "}"
    wide = json.dumps({"dependencies": {f"w{i}": {"version": f"{i}.0.0", "dependencies": {"x": {"version": 1}, "y": None, "z": "no"}} for i in range(2000)}})
    odd = '{"dependencies": {"a": {"version": null}, "b": [1], "": {"version": "2"}, "c": {"version": {"x": 1}, "dependencies": "no"}}}'
    too_deep = '{"dependencies": ' + '{"d": {"dependencies": ' * 70 + "{}" + "}}" * 70 + "}"
    files = [("deep", deep), ("wide", wide), ("odd", odd), ("too deep", too_deep), ("none", '{"dependencies": null}'), ("list", '{"dependencies": [1]}'), ("bad", '{"dependencies": {')]
    df = spark.createDataFrame([(p, "package-lock-json", c) for p, c in files], "relative_path string, parser string, content string")
    found = parse.components(df, ["package-lock-json"])
    rows = sorted(found.collect(), key=lambda r: (r["relative_path"], r["place"]))
    of = lambda p: [(r["name"], r["version"]) for r in rows if r["relative_path"] == p]
    assert of("deep") == [(f"d{i}", f"1.0.{i}") for i in range(60)]
    assert of("wide") == [x for i in range(2000) for x in ((f"w{i}", f"{i}.0.0"), ("x", "1"))]
    assert of("odd") == [("a", ""), ("c", "")] and not any(map(of, ("too deep", "none", "list", "bad")))
    status = {r["relative_path"]: r["status"] for r in parse.outcomes(df, found).collect()}
    assert status == {"deep": "parsed", "wide": "parsed", "odd": "parsed", "none": "parsed", "list": "parsed", "too deep": "failed", "bad": "failed"}
