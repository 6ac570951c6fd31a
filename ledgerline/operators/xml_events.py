"""Manifests in XML as an event table: one row per element, so that parsers are filters.

A pull reader takes each file once, in order. It rejects document types, decodes entities
and CDATA, and names elements by their local names. What the rows say of their place in
the tree is in two paths, one of exact names and one of lower-case names, each step with
its number among the siblings of that name: `project[1]/dependencies[1]/dependency[2]`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters of a document, levels of elements, and bytes of an element's text.
MAX_CHARACTERS, MAX_DEPTH, MAX_TEXT = 16 << 20, 256, 1 << 16
EVENTS = "relative_path string, node long, parent long, path string, folded string, attributes map<string,string>, text string"
#: Rows that are handed on at once.
BATCH = 4096


class Refused(Exception):
    """A document that isn't read; its message is the code."""


def read_elements(content: str | None) -> Iterator[tuple]:
    """(node, parent, path, folded, attributes, text) of each element, where it ends. node
    numbers elements as they start, from 0; the root's parent is -1. text is all text in
    the element and below, or null beyond MAX_TEXT. Raises Refused."""
    if not content or not content.strip():
        raise Refused("empty")
    if len(content) > MAX_CHARACTERS:
        raise Refused("size")
    stack: list[list] = []
    done: list[tuple] = []
    number = 0

    def refuse(*_) -> None:
        raise Refused("doctype")

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal number
        if len(stack) == MAX_DEPTH:
            raise Refused("depth")
        local = name.rpartition(":")[2]
        low = local.lower() if local.isascii() else "".join(c.lower() if c.isascii() else c for c in local)
        steps = (f"{local}[1]", f"{low}[1]")
        if stack:
            above = stack[-1]
            above[5][local] += 1
            above[6][low] += 1
            steps = (f"{above[2]}/{local}[{above[5][local]}]", f"{above[3]}/{low}[{above[6][low]}]")
        #: node, parent, paths, attributes, names and folded names below, text, its size
        stack.append([number, stack[-1][0] if stack else -1, *steps, attributes, Counter(), Counter(), [], 0])
        number += 1

    def data(text: str) -> None:
        if stack[-1][8] <= MAX_TEXT:
            stack[-1][7].append(text)
            stack[-1][8] += len(text)

    def end(_: str) -> None:
        node, parent, path, folded, attributes, _, _, parts, size = stack.pop()
        text = "".join(parts) if size <= MAX_TEXT else None
        if stack:
            stack[-1][8] += size
            if stack[-1][8] <= MAX_TEXT:
                stack[-1][7].append(text)
        done.append((node, parent, path, folded, attributes, text))

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.StartDoctypeDeclHandler = refuse
    try:
        for at in range(0, len(content), 1 << 20):
            parser.Parse(content[at : at + (1 << 20)], False)
            yield from done
            done.clear()
        parser.Parse("", True)
    except expat.ExpatError:
        raise Refused("malformed") from None
    yield from done


def xml_error(content: Column) -> Column:
    """Why a document is refused: empty, size, doctype, depth or malformed; else ''."""

    def judge(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> str:
            try:
                for _ in read_elements(text):
                    pass
            except Refused as e:
                return str(e)
            return ""

        return texts.map(of)

    return F.pandas_udf(judge, StringType())(F.coalesce(content, F.lit("")))


def xml_events(files: DataFrame) -> DataFrame:
    """The elements of files (relative_path, content); see read_elements. A file that is
    refused has none, even if it starts well."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(EVENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of several files, so that small ones share a batch
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:  # a large one is read once to see whether it is sound, so that few rows are held
                    found: Iterable[tuple] = list(islice(read_elements(content.as_py()), BATCH))
                    if len(found) == BATCH:
                        for _ in read_elements(content.as_py()):
                            pass
                        found = read_elements(content.as_py())
                except Refused:
                    continue
                for *own, attributes, text in found:
                    rows.append((path, *own, list(attributes.items()), text))
                    if len(rows) >= BATCH:
                        yield _batch(rows, arrow)
                        rows = []
        if rows:
            yield _batch(rows, arrow)

    return files.select("relative_path", "content").mapInArrow(run, EVENTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
