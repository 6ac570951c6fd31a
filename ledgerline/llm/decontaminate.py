"""Operator 3: benchmark decontamination by size-partitioned MinHash containment.

Test items are short and documents long, so the similarity of their whole shingle sets
says little; what counts is how much of the item lies inside the document. Items are
partitioned by their number of distinct shingles. In each partition every item keeps a
bottom-k MinHash sketch, its k shingles of least hash, with k one more than the shingles
that an item of that partition may lack at the threshold. Then an item that reaches the
threshold shares at least one sketched shingle with the document, whichever shingles are
missing: the candidate search loses nothing. Candidates are verified by counting the
item's shingles in the document, compared as words.

A pass over the documents carries one block of items, bounded by their text; documents
are never shuffled. Equal texts are one item until the end, and blocks follow each other,
each dropped when its pass is written, so the driver and the tasks hold one at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_batches, saved, texts_of

WORD = re.compile(r"\w+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Characters of item text that one pass over the documents carries.
BLOCK_CHARS = 16 << 20


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.lower())


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def sketch(found: set[tuple[str, ...]], k: int) -> list[tuple[str, ...]]:
    return sorted(found, key=lambda s: (xxhash.xxh64_intdigest(" ".join(s).encode()), s))[:k]


@dataclass
class ItemIndex:
    """One block of items, ready to be probed."""

    numbers: dict[str, int]
    #: by width: sorted hashes of sketched shingles, and hash -> items
    widths: dict[int, tuple[np.ndarray, dict[int, list[int]]]]
    items: list[tuple[str, int, set[tuple[str, ...]]]]
    threshold: float

    def hashes(self, ids: np.ndarray, width: int) -> np.ndarray:
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        whole = np.ones(n, bool)
        for i in range(width):
            part = ids[i : i + n]
            h = (h ^ part) * MULTIPLIER
            h ^= h >> np.uint64(29)
            whole &= part != 0
        return np.where(whole, h, np.uint64(0))

    def probe(self, text: str) -> list[tuple[int, int, int]]:
        """(item's position, shared shingles, its shingles) of each contained item."""
        words = words_of(text)
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        out = []
        for width, (sketched, owners) in self.widths.items():
            h = self.hashes(ids, width)
            if not len(h) or not len(sketched):
                continue
            at = np.searchsorted(sketched, h)
            at[at == len(sketched)] = 0
            hits = np.unique(h[sketched[at] == h])
            candidates = sorted({i for x in hits.tolist() for i in owners.get(x, ())})
            if not candidates:
                continue
            held = {tuple(words[p : p + width]) for p in np.flatnonzero(h).tolist()}
            for i in candidates:
                own = self.items[i][2]
                shared = len(own & held)
                if shared >= self.threshold * len(own):
                    out.append((i, shared, len(own)))
        return out


def build_index(items: list[tuple], width: int, threshold: float) -> ItemIndex:
    parts: dict[tuple[int, int], list[int]] = defaultdict(list)
    kept: list[tuple[str, int, set]] = []
    numbers: dict[str, int] = {}
    for item, text in items:
        words = words_of(text or "")
        if not words:
            continue
        for w in words:
            numbers.setdefault(w, len(numbers) + 1)
        own_width = min(width, len(words))
        found = shingles(words, own_width)
        parts[own_width, len(found).bit_length()].append(len(kept))
        kept.append((item, own_width, found))
    index = ItemIndex(numbers, {}, kept, threshold)
    owners: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for (own_width, _), members in parts.items():
        largest = max(len(kept[i][2]) for i in members)
        k = int(np.floor((1 - threshold) * largest + 1e-9)) + 1
        for i in members:
            for s in sketch(kept[i][2], k):
                ids = np.array([numbers[w] for w in s], np.uint64)
                owners[own_width][int(index.hashes(ids, own_width)[0])].append(i)
    for own_width, of in owners.items():
        index.widths[own_width] = (np.array(sorted(of), np.uint64), dict(of))
    return index


PAIRS = "doc_id long, item string, n_shared long, n_item_shingles long, containment double"


def find_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per document row and item row whose containment, the share of the item's
    distinct shingles that the document has, is threshold or more.

    Items of fewer than width words count as one shingle of all their words; items
    without words (null or empty texts too) match nothing. Null ids and repeated rows are
    kept; empty tables give an empty result; other columns are ignored.
    """
    own = keyed(docs, id_col, text_col)
    tests = _named(items, item_id_col, item_text_col)
    pairs = _passes(own, tests, width, threshold, lambda docs, index: map_batches(docs, partial(_pairs, index), PAIRS), union=True)
    return pairs.join(tests.select("item", "item_id"), "item").select("doc_id", "item_id", "n_shared", "n_item_shingles", "containment")


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item. Rows are
    dropped where they are read, each by its own text, so null and repeated ids need no
    join."""
    at = docs.columns.index(text_col)
    tests = _named(items, item_id_col, item_text_col)
    return _passes(docs, tests, width, threshold, lambda docs, index: docs.mapInArrow(partial(_clean, index, at), docs.schema), union=False)


def _named(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a digest of the text), item_id and text of the items with a text."""
    tests = keyed(items, id_col, text_col).where("text IS NOT NULL")
    return tests.select(F.sha2("text", 256).alias("item"), F.col("doc_id").alias("item_id"), "text")


def _passes(docs: DataFrame, tests: DataFrame, width: int, threshold: float, one: Callable, union: bool) -> DataFrame:
    """one(docs, index) for each block of the items' texts of about BLOCK_CHARS: all its
    results together, or one after the other."""
    spark, texts = docs.sparkSession, tests.select("item", "text").distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks, results = int(total // BLOCK_CHARS) + 1, []
    for b in range(n_blocks):
        block = texts.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).collect()
        index = spark.sparkContext.broadcast(build_index([(r["item"], r["text"]) for r in block], width, threshold))
        del block
        found = one(docs, index)
        if n_blocks > 1:
            found = saved(found, "contaminated")
            index.destroy()
        results.append(found)
        docs = docs if union else found
    return reduce(DataFrame.unionByName, results) if union else docs


def _clean(shared: Broadcast, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for batch in batches:
        yield batch.filter(pa.array([not index.probe(t) for t in texts_of(batch.column(at))], pa.bool_()))


def _pairs(shared: Broadcast, batch: pa.RecordBatch) -> dict:
    index: ItemIndex = shared.value
    rows = [
        (doc, index.items[i][0], shared, n, shared / n)
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True)
        for i, shared, n in index.probe(text)
    ]
    names = [x.split()[0] for x in PAIRS.split(", ")]
    return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))
