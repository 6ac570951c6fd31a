"""Operator 1: token counts by offset-mapped attribution.

A document is encoded once, whole. Each token's span of code points is joined to the
document's sections by interval; a token that touches several sections belongs to the
one it overlaps most, and to the earlier of two that tie. Tokens that touch no section
are counted under section -1, so that a document's rows add up to its tokens.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import arrow_schema, to_batch

ROWS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(2)
def encoding(ranks_path: str, pattern: str):
    """The tokenizer and each id's number of bytes."""
    import tiktoken

    ranks = read_ranks(ranks_path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in code points. A token with part of a character's
    bytes spans that character."""
    last = np.cumsum(sizes[ids])
    first = last - sizes[ids]
    if text.isascii():
        return first, last
    raw = np.frombuffer(text.encode(), np.uint8)
    of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    return of_byte[first], of_byte[last - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, without their line feeds."""
    sizes = np.fromiter(map(len, text.split("\n")), np.int64)
    end = np.cumsum(sizes + 1) - 1
    return end - sizes, end


def attribute(
    starts: np.ndarray, ends: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether it touches more than one.
    Sections are in order and apart; empty ones get nothing."""
    low = np.searchsorted(sec_end, starts, "right")
    high = np.searchsorted(sec_start, ends, "left")
    owner = np.where(high > low, low, -1)
    crossing = high - low > 1
    for t in np.flatnonzero(crossing):
        k = np.arange(low[t], high[t])
        shared = np.minimum(sec_end[k], ends[t]) - np.maximum(sec_start[k], starts[t])
        owner[t] = k[np.argmax(shared)] if shared.max() > 0 else -1
        crossing[t] = np.count_nonzero(shared > 0) > 1
    single = np.flatnonzero(owner >= 0)
    s = owner[single]
    empty = np.minimum(sec_end[s], ends[single]) <= np.maximum(sec_start[s], starts[single])
    owner[single[empty]] = -1
    return owner, crossing


def apart(spans: list[tuple[int | None, int | None]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in the order of their text, cut so that none overlaps one before it:
    which span each is, start and end. Spans without text come first, as empty ones."""
    bad = [a is None or b is None or not 0 <= a <= b for a, b in spans]
    pairs = np.array([(0, 0) if x else p for p, x in zip(spans, bad, strict=True)], np.int64).reshape(-1, 2)
    start, end = np.minimum(pairs, size).T
    order = np.lexsort((end, start, ~np.array(bad, bool)))
    start, end = start[order], end[order]
    reach = np.maximum.accumulate(np.append(0, end))[:-1]
    start = np.maximum(start, reach)
    return order, start, np.maximum(start, end)


def count_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
) -> DataFrame:
    """One row per section of each document, and one with section -1 (start and end null)
    where tokens lie outside every section: n_tokens, n_crossing (of those, tokens that
    touch another section too) and doc_tokens of the whole document.

    sections_col names an array<struct<start, end>> column of spans in code points;
    without it, the lines are the sections. Spans are cut at the text's end. Of spans that
    overlap, those which begin first (of them, the one that ends first) have the shared
    part. A null span, or one with a null or negative bound or with its end before its
    start, is a section without text; start and end are given back as they are. Null texts are empty: their one line gets
    a row with no tokens. Null sections are none. Null ids and repeated rows are kept; an
    empty table gives an empty result; other columns are ignored.
    """
    sections = F.col(f"`{sections_col}`") if sections_col else F.lit(None)
    own = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        sections.cast("array<struct<start:long,end:long>>").alias("sections"),
    )
    schema = arrow_schema(docs.sparkSession, ROWS)
    lines = sections_col is None

    def run(batches):
        codec, sizes = encoding(ranks_path, pattern)
        for batch in batches:
            parts: list[tuple] = []
            for doc, text, spans in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True
            ):
                text = text.as_py() or ""
                if lines:
                    s0, s1 = line_sections(text)
                else:
                    given = [(None, None) if x is None else (x["start"], x["end"]) for x in spans or []]
                    order, s0, s1 = apart(given, len(text))
                ids = np.array(codec.encode_ordinary(text), np.int64)
                owner, crossing = attribute(*token_spans(text, ids, sizes), s0, s1)
                if lines:
                    starts, ends = s0.tolist(), s1.tolist()
                else:
                    owner = np.append(order, -1)[owner]
                    starts, ends = ([None if x is None else min(x, len(text)) for x in xs] for xs in zip(*given, strict=True)) if given else ([], [])
                n = np.bincount(owner + 1, minlength=len(s0) + 1)
                c = np.bincount(owner[crossing] + 1, minlength=len(s0) + 1)
                first = 0 if n[0] else 1
                k = np.arange(first - 1, len(s0))
                pad = [None] if first == 0 else []
                parts.append(
                    ([doc] * len(k), k, [*pad, *starts], [*pad, *ends], n[first:], c[first:], [len(ids)] * len(k))
                )
                if len(parts) >= 2000:
                    yield _batch(parts, schema)
                    parts = []
            if parts:
                yield _batch(parts, schema)

    return own.mapInArrow(run, ROWS)


def _batch(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[x for p in parts for x in p[i]] for i in range(len(schema))]
    columns[1] = np.concatenate([p[1] for p in parts]).astype(np.int32)
    return to_batch(dict(zip(schema.names, columns, strict=True)), schema)
