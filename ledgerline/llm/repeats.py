"""Operator 10: repeated passages by maximal repeats of a distributed suffix array.

Every 50-byte window of every text belongs to the partition of its anchor, the 16-byte
piece of least hash inside it, so that equal windows meet. Runs of windows with one
anchor are cut out as segments; long repeats are cut alike in every document, as the cuts
depend on the text alone (but for one cut in every CHUNK_BYTES of a very long text, which
costs time only).
A partition builds the enhanced suffix array (suffixes, common prefixes, bytes to the
left) of its distinct segments, scans the common-prefix intervals with a stack, and
keeps intervals of 50 bytes or more whose left bytes differ: the maximal repeats. All
occurrences count, not only neighbours in the array. Only the part of the array that can
hold such intervals is sorted: suffixes that share their first 50 bytes with another, in
groups whose left bytes differ. A segment that several documents have is an interval of
its own, with all of them as occurrences.

Documents are dealt to blocks of bounded size by a hash of their id, and a block asks
about each distinct anchor and segment once, however many of its documents hold it, so a
passage in a third of all documents costs one question per block. Anchors that only one
document has are sorted out first by their hashes alone. An anchor with very many
different segments (a short phrase in many surroundings) is dealt again, by the hashes of
its windows, so no partition depends on one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_schema, keyed

LENGTH = 50
PIECE = 16
#: Text bytes of a block, and windows that are searched for anchors at once.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 256 << 10
#: Different segments around one anchor beyond which its windows are dealt on their own.
CROWDED = 1 << 14
#: Fixed odd factors of the hashes.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
KEY_BITS = 47

U = np.uint64
NONE = np.zeros(0, np.int64)


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; beyond the end, zeros."""
    padded = np.zeros(len(text) + 16, np.uint8)
    padded[: len(text)] = text
    out = np.empty(len(padded) - 7, "<u8")
    for shift in range(8):
        out[shift::8] = np.frombuffer(padded, "<u8", (len(padded) - shift) // 8, shift)[: len(out[shift::8])]
    return out[: len(text)]


def _stirred(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h ^= h >> U(32)
    h += word
    h *= FACTORS[1]
    return h


def _finished(h: np.ndarray) -> np.ndarray:
    h ^= h >> U(32)
    h *= FACTORS[2]
    h ^= h >> U(29)
    return h


def body_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each text[start:end]; starts ascend, each has 8 bytes at least."""
    out = np.empty(len(start), U)
    longest = int((end - start).max()) if len(start) else 0
    at = 0
    while at < len(start):
        low = int(start[at])
        upto = max(at + 1, int(np.searchsorted(start, low + CHUNK_BYTES)))
        w = words(text[low : int(end[at:upto].max())])
        s, last = start[at:upto] - low, end[at:upto] - low - 8
        h = (last - s + 8 + (seed << 20)).astype(U) * FACTORS[0]
        for k in range(0, longest, 8):
            h = _stirred(h, w[np.minimum(s + k, last)])
        out[at:upto] = _finished(h)
        at = upto
    return out


def window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the length bytes from each position on."""
    n = len(text) - length + 1
    more = [*range(8, length - 8, 8), length - 8] if length > 8 else []
    used = U((1 << 8 * min(length, 8)) - 1)
    out = np.empty(max(n, 0), U)
    for a in range(0, n, CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, n)
        w = words(text[a : b + length - 1])
        h = (w[: b - a] & used) * FACTORS[0]
        for k in more:
            h = _stirred(h, w[k : k + b - a])
        out[a:b] = _finished(h)
    return out


def segments(text: np.ndarray, edges: np.ndarray, length: int = LENGTH, chunk: int = CHUNK_BYTES) -> tuple[np.ndarray, ...]:
    """Anchor hash, document, start and end of each segment of concatenated texts whose
    edges are given (one more than there are texts). A segment is the bytes of
    consecutive windows, within one text, that have the same anchor."""
    n_windows = len(text) - length + 1
    after = np.maximum(edges[:-1], edges[1:] - length + 1)  # one past each text's last window
    found = []
    position = U((1 << 24) - 1)
    b = 0
    while b < n_windows:
        # at texts' edges where possible, else at a distance from the text's beginning
        a, edge = b, int(edges[np.searchsorted(edges, b + chunk, "right") - 1])
        b = min(edge if edge > a else a + chunk, n_windows)
        w = words(text[a : b + length - 1])
        n = b - a + length - PIECE
        h = w[:n] * FACTORS[0]
        for k in range(8, PIECE, 8):
            h = _stirred(h, w[k : k + n])
        h = _finished(h)
        # least hash first, then leftmost: 40 bits of hash over 24 bits of position
        least = (h & ~position) | np.arange(n, dtype=U)
        need, width = length - PIECE + 1, 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if need > width:
            least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
        cuts = [np.zeros(1, np.int64), np.flatnonzero(least[1:] != least[:-1]) + 1]
        for of in (edges, after):
            low, high = np.searchsorted(of, [a + 1, b])
            cuts.append(of[low:high] - a)
        cut = np.sort(np.concatenate(cuts), kind="stable")
        cut = cut[np.append(True, cut[1:] != cut[:-1])]
        first, last = cut + a, np.append(cut[1:], b - a) + a
        doc = np.searchsorted(edges[1:], first, "right")
        inside = first < after[doc]
        # the least hashes are small numbers: stirred, they spread over all buckets
        key = _finished(h[(least[cut[inside]] & position).astype(np.int64)])
        found.append((key, doc[inside], first[inside], last[inside] + length - 1))
    if not found:
        return np.zeros(0, U), NONE, NONE, NONE
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def gathered(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of text[start:start + size], one after the other."""
    before = np.cumsum(size) - size
    return text[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + size - 1 of each, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def alike(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal texts, and the set of each."""
    for seed in count(0, 2):
        _, first, which = np.unique(body_hashes(text, start, end, seed), return_index=True, return_inverse=True)
        check = body_hashes(text, start, end, seed + 1)
        if (check == check[first][which]).all():
            return first, which
    raise AssertionError


def suffix_order(
    text: np.ndarray, where: np.ndarray, limit: np.ndarray, group: np.ndarray | None = None, depth: int = 0
) -> np.ndarray:
    """Positions where (with limit bytes each up to their segment's end) in the order of
    their suffixes; equal suffixes of different lengths put the shorter one first. Sorts
    by eight bytes at a time, going on only inside runs that still tie. A group (ascending,
    the first place of each run) may say which are known to share their first depth bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order = np.arange(len(where))
    group = np.zeros(len(where), np.int64) if group is None else group.copy()
    live = np.arange(len(where))  # places in the order that still tie
    while len(live):
        own = order[live]
        left = np.clip(limit[own] - depth, 0, 8)
        raw = view[np.minimum(where[own] + depth, len(text))].copy()
        key = raw.view(">u8").reshape(-1).astype(U)
        shift = np.minimum((8 * (8 - left)).astype(U), U(63))
        key = np.where(left > 0, (key >> shift) << shift, U(0))
        ranked = np.lexsort((left, key, group[live]))
        order[live] = own[ranked]
        key, left, old = key[ranked], left[ranked], group[live]
        change = np.append(True, (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (old[1:] != old[:-1]))
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(live)))
        group[live] = live[start][np.cumsum(change) - 1]
        live = live[np.repeat((size > 1) & (left[start] == 8), size)]
        depth += 8
    return order


def common_prefixes(text: np.ndarray, where: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the one before it (0 for the first)."""
    n = len(where)
    out = np.zeros(n, np.int64)
    live = np.arange(1, n)
    depth = 0
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    most = np.minimum(limit[1:], limit[:-1])
    while len(live):
        a = view[np.minimum(where[live - 1] + depth, len(text))]
        b = view[np.minimum(where[live] + depth, len(text))]
        differ = a != b
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        out[live] += same
        live = live[(same == 8) & (out[live] < most[live - 1])]
        depth += 8
    out[1:] = np.minimum(out[1:], most)
    return out


def maximal_repeats(prefix: np.ndarray, left: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Stack-scan of the common-prefix intervals: (first, last, common prefix, least
    owner) of each interval of length or more whose left bytes differ. left is the byte
    before each suffix, negative and different for each text's beginning."""
    out: list[tuple[int, int, int, int]] = []
    if not len(prefix):
        return out
    deep = prefix >= length
    ends = np.append(deep[:-1] & ~deep[1:], False)  # the places where the last interval closes
    steps = np.flatnonzero(deep | np.append(False, ends[:-1])).tolist()
    if deep[-1]:
        steps.append(len(prefix))
    stack: list[list] = []  # common prefix, first, least owner, left byte or None if they differ
    values, lefts, owners = [*prefix.tolist(), 0], left.tolist(), owner.tolist()
    for i in steps:
        depth = values[i]
        first, least, byte = i - 1, owners[i - 1], lefts[i - 1]
        while stack and stack[-1][0] > depth:
            top, start, low, seen = stack.pop()
            low = min(low, least)
            seen = seen if seen == byte else None
            if seen is None:
                out.append((start, i - 1, top, low))
            first, least, byte = start, low, seen
        if depth < length:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1][2] = min(stack[-1][2], least)
            if stack[-1][3] != byte:
                stack[-1][3] = None
        else:
            stack.append([depth, first, least, byte])
    return out


class Intervals:
    """The maximal repeats of distinct segments (concatenated, with their sizes) whose
    least document ids are given."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH):
        base = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - length + 1, 0)
        where = ranges(base, counts)
        of = np.repeat(np.arange(len(sizes)), counts)
        where, of, group = self._meeting(text, where, of, base, length)
        order = suffix_order(text, where, base[of] + sizes[of] - where, group, length)
        self.where, self.of = where[order], of[order]
        self.offset = self.where - base[self.of]
        self.owner = owners[self.of]
        prefix = common_prefixes(text, self.where, sizes[self.of] - self.offset)
        left = np.where(self.offset > 0, text[np.maximum(self.where - 1, 0)].astype(np.int64), -1 - self.of)
        self.found = maximal_repeats(prefix, left, self.owner, length)

    @staticmethod
    def _meeting(text, where, of, base, length):
        """The suffixes that share their first bytes with another, in groups (the place
        of a group's first suffix) whose left bytes differ: no other can stand in an
        interval that is a maximal repeat."""
        if not len(where):
            return where, of, where
        h = window_hashes(text, length)[where]
        # most stand alone, which 40 bits of the hash tell: over 24 bits of position, again
        position = U((1 << 24) - 1)
        if len(h) <= int(position):
            alone = np.ones(len(h), bool)
            ranked = np.sort((h & ~position) | np.arange(len(h), dtype=U))
            same = (ranked[1:] ^ ranked[:-1]) <= position
            alone[(ranked[1:][same] & position).astype(np.int64)] = False
            alone[(ranked[:-1][same] & position).astype(np.int64)] = False
            where, of, h = where[~alone], of[~alone], h[~alone]
        order = np.argsort(h)
        new = np.append(True, h[order[1:]] != h[order[:-1]])[: len(order)]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        several = np.repeat(size > 1, size)
        order, new = order[several], new[several]
        where, of = where[order], of[order]
        if not len(where):
            return where, of, where
        left = np.where(where > base[of], text[np.maximum(where - 1, 0)].astype(np.int64), -1 - of)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(where)))
        differ = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
        keep = np.repeat(differ, size)
        where, of, size = where[keep], of[keep], size[differ]
        first = np.cumsum(size) - size
        # equal hashes of unequal bytes would hide an order: then sort from the start
        padded = np.lib.stride_tricks.sliding_window_view(text, length)
        leader = np.repeat(where[first], size)
        step = max(1, (16 << 20) // length)
        for a in range(0, len(where), step):
            if (padded[where[a : a + step]] != padded[leader[a : a + step]]).any():
                fresh = suffix_order(text, where, np.full(len(where), length))
                where, of = where[fresh], of[fresh]
                differs = (padded[where[1:]] != padded[where[:-1]]).any(axis=1)
                first = np.flatnonzero(np.append(True, differs))
                size = np.diff(np.append(first, len(where)))
                break
        return where, of, np.repeat(first, size)

    def later_parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, end, least id) of the occurrences that a smaller id has too."""
        if not self.found:
            return NONE, NONE, NONE, NONE
        first, last, top, low = np.array(self.found, np.int64).T
        size = last - first + 1
        at, top, low = ranges(first, size), np.repeat(top, size), np.repeat(low, size)
        later = self.owner[at] > low
        at, top, low = at[later], top[later], low[later]
        return self.of[at], self.offset[at], self.offset[at] + top, low

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, end) of every occurrence of every maximal repeat."""
        if not self.found:
            return NONE, NONE, NONE
        first, last, top, _ = np.array(self.found, np.int64).T
        size = last - first + 1
        at = ranges(first, size)
        return self.of[at], self.offset[at], self.offset[at] + np.repeat(top, size)


def shared_parts(bodies: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For distinct segments and the least document id of each: the parts that also
    start in a smaller document, as (segment, start, end, that document's id)."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    return Intervals(np.frombuffer(b"".join(bodies), np.uint8), sizes, owners, length).later_parts()


def packed(values: np.ndarray) -> bytes:
    """Numbers, compressed plane by plane: first their lowest bytes, then the next."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def bucket_of(key: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so what is sorted by key is sorted by bucket."""
    return ((key >> U(16)) * U(n_buckets) >> U(KEY_BITS - 16)).astype(np.int64)


class Block:
    """The segments of a block's documents, and what the block asks about."""

    def __init__(self, table: pa.Table, n_buckets: int):
        self.n_buckets = n_buckets
        self.own_ids = table.column("doc_id")
        self.id_of = np.array([NO_ID if x is None else x for x in self.own_ids.to_pylist()], np.int64)
        raw = pa.concat_arrays(table.column("raw").cast(pa.large_binary()).chunks)
        _, edges, data = raw.buffers()
        edges = np.frombuffer(edges, np.int64)[raw.offset : raw.offset + len(raw) + 1]
        held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.text, self.edges = held[edges[0] : edges[-1]], edges - edges[0]
        key, self.doc, self.start, self.end = segments(self.text, self.edges)
        self.key = key >> U(64 - KEY_BITS)
        self.body = body_hashes(self.text, self.start, self.end)
        # by key, then by the body's first bits, which is enough to estimate how many differ
        self.order = np.argsort(self.key << U(64 - KEY_BITS) | self.body >> U(KEY_BITS))
        ranked = self.key[self.order]
        self.new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        self.first = np.flatnonzero(self.new)
        self.anchors = ranked[self.first]

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct anchor: whether two documents of the block have it, and how
        many different segments, as a power of two."""
        if not len(self.first):
            return NONE, NONE
        doc, body = self.doc[self.order], self.body[self.order]
        several = np.minimum.reduceat(doc, self.first) != np.maximum.reduceat(doc, self.first)
        other = np.append(True, body[1:] != body[:-1]) | self.new
        different = np.add.reduceat(other.astype(np.int64), self.first)
        return several, np.ceil(np.log2(different)).astype(np.int64)

    def pieces(self, answers: list[tuple[int, bytes, bytes | None]]) -> Pieces:
        """What the block asks the second time, by the first answers."""
        bucket = bucket_of(self.anchors, self.n_buckets)
        shared, crowded = np.zeros(len(self.anchors), bool), np.zeros(len(self.anchors), bool)
        for b, bits, more in answers:
            low, high = np.searchsorted(bucket, [b, b + 1])
            for flags, found in ((shared, bits), (crowded, more)):
                if found is not None:
                    flags[low:high] = np.unpackbits(np.frombuffer(found, np.uint8), count=high - low)
        anchor = np.cumsum(self.new) - 1
        whole = self.order[(shared & ~crowded)[anchor]]
        split = np.sort(self.order[crowded[anchor]])
        key, body, doc = self.key[whole], self.body[whole], self.doc[whole]
        start, end = self.start[whole], self.end[whole]
        if len(split):  # one piece for each window
            n = self.end[split] - self.start[split] - LENGTH + 1
            at = ranges(self.start[split], n)
            h = body_hashes(self.text, at, at + LENGTH)
            key, body = np.append(key, h >> U(64 - KEY_BITS)), np.append(body, h)
            doc, start, end = np.append(doc, np.repeat(self.doc[split], n)), np.append(start, at), np.append(end, at + LENGTH)
        # questions are numbered alike in whatever order the block's rows come
        order = np.lexsort((body, key))
        return Pieces(self, key[order], body[order], doc[order], start[order], end[order])


class Pieces:
    """Segments (or windows) of a block in the order of their keys and bodies; equal ones
    are asked about once."""

    def __init__(self, block: Block, key, body, doc, start, end):
        self.doc, self.start, self.end = doc, start, end
        new = np.append(True, (key[1:] != key[:-1]) | (body[1:] != body[:-1]))[: len(key)]
        self.first = np.flatnonzero(new)
        self.which = np.cumsum(new) - 1
        self.ids = block.id_of[doc]
        bucket = bucket_of(key[self.first], block.n_buckets)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        self.parts = [(int(bucket[a]), int(a), int(z)) for a, z in zip(cut, np.append(cut[1:], len(bucket)), strict=True)]


ANCHORS = "bucket int, block long, anchors binary"
ANSWERS = "block long, step int, bucket int, a binary, b binary"
BODIES = "bucket int, block long, sizes binary, least binary, most binary, bodies binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
GROUPS = "repeat binary, doc_id long, start long, end long"
TEXTS = "block long, texts binary"
#: Text bytes that a task holds while it packs them by block.
PACKED_BYTES = 32 << 20


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, raw) as a compressed Arrow stream per block, so that the
    exchange holds fewer bytes than the texts have."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACKED_BYTES:
            yield _packed_texts(held)
            held, size = [], 0
    if held:
        yield _packed_texts(held)


def _packed_texts(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).sort_by("block")
    block = table.column("block").to_numpy()
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
    rows, own = [], table.select(["doc_id", "raw"])
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=True):
        sink = pa.BufferOutputStream()
        part = own.slice(a, z - a).combine_chunks()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(part)
        rows.append((int(block[a]), sink.getvalue().to_pybytes()))
    numbers, texts = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], names=["block", "texts"])


def unpack_texts(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("texts")])




def ask_anchors(block_id: int, block: Block) -> list[tuple]:
    several, power = block.asked()
    bucket = bucket_of(block.anchors, block.n_buckets)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    # keys ascend: the steps between them, a bit for several documents, seven for the power of two
    step = np.diff(block.anchors, prepend=U(0))
    step[cuts] = block.anchors[cuts]
    stored = (step << U(8) | several.astype(U) << U(7) | power.astype(U)).astype("<u8")
    return [
        (int(bucket[a]), block_id, packed(stored[a:z]))
        for a, z in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True)
    ]


def answer_anchors(bucket: int, blocks: list[int], asked: list[bytes], crowded: int = CROWDED) -> list[tuple]:
    """For each block, a bit for each anchor it asked about: whether two documents have
    it; and another, if any is set: whether its segments are too many for one place."""
    each = [unpacked(a, "<u8") for a in asked]
    sizes = [len(a) for a in each]
    key, held = np.concatenate([np.cumsum(a >> U(8)) for a in each]), np.concatenate(each)
    order = np.argsort(key)
    ranked = key[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])
    size = np.diff(np.append(first, len(key)))
    held = held[order]
    several = np.maximum.reduceat((held >> U(7)) & U(1), first).astype(bool) | (size > 1)
    many = np.add.reduceat(np.int64(1) << (held & U(127)).astype(np.int64), first) > crowded
    shared, split = np.zeros(len(key), bool), np.zeros(len(key), bool)
    shared[order] = np.repeat(several, size)
    split[order] = np.repeat(several & many, size)
    edges = np.cumsum([0, *sizes])
    return [
        (block, 1, bucket, np.packbits(shared[a:z]).tobytes(), np.packbits(split[a:z]).tobytes() if split[a:z].any() else None)
        for block, a, z in zip(blocks, edges[:-1], edges[1:], strict=True)
        if shared[a:z].any()
    ]


def ask_bodies(block_id: int, block: Block, pieces: Pieces) -> list[tuple]:
    import zstandard

    if not len(pieces.first):
        return []
    least = np.minimum.reduceat(pieces.ids, pieces.first)
    most = np.maximum.reduceat(pieces.ids, pieces.first)
    start = pieces.start[pieces.first]
    size = pieces.end[pieces.first] - start
    packer = zstandard.ZstdCompressor(level=3)
    return [
        (
            bucket,
            block_id,
            packed(size[a:z].astype(np.uint8)),
            packed(least[a:z].astype("<i8")),
            packed((most[a:z] != least[a:z]).astype(np.uint8)),
            packer.compress(gathered(block.text, start[a:z], size[a:z]).tobytes()),
        )
        for bucket, a, z in pieces.parts
    ]


class Bucket:
    """The distinct segments of a bucket: which blocks have them, and their intervals."""

    def __init__(self, asked: list[tuple[int, bytes, bytes, bytes, bytes]]):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        self.blocks = [block for block, *_ in asked]
        sizes = [unpacked(a[1], "u1") for a in asked]
        self.edges = np.cumsum([0, *map(len, sizes)])
        size = np.concatenate(sizes).astype(np.int64)
        self.mine = np.concatenate([unpacked(a[2], "<i8") for a in asked])
        several = np.concatenate([unpacked(a[3], "u1") for a in asked])
        text = np.frombuffer(b"".join(unpacker.decompress(a[4]) for a in asked), np.uint8)
        end = np.cumsum(size)
        first, self.which = alike(text, end - size, end)
        self.text = gathered(text, (end - size)[first], size[first])
        self.sizes = size[first]
        order = np.argsort(self.which, kind="stable")
        runs = np.searchsorted(self.which[order], np.arange(len(first)))
        self.least = np.minimum.reduceat(self.mine[order], runs)
        # two documents have it: two in one block, or different least ones in two blocks
        self.repeated = (np.maximum.reduceat(self.mine[order], runs) != self.least) | np.maximum.reduceat(several[order], runs).astype(bool)
        self.intervals = Intervals(self.text, self.sizes, self.least)

    def parts_by_block(self, of: np.ndarray, start: np.ndarray, end: np.ndarray, only_least: bool):
        """(block, range of its questions, question, row of the given parts)."""
        order = np.argsort(of, kind="stable")
        of, start, end = of[order], start[order], end[order]
        for block, a, z in zip(self.blocks, self.edges[:-1], self.edges[1:], strict=True):
            w = self.which[a:z]
            own = np.flatnonzero(self.mine[a:z] == self.least[w]) if only_least else np.arange(len(w))
            low, high = np.searchsorted(of, w[own]), np.searchsorted(of, w[own], "right")
            rows = ranges(low, high - low)
            yield block, w, np.repeat(own, high - low), start[rows], end[rows], of[rows]


def answer_bodies(bucket: int, asked: list[tuple]) -> list[tuple]:
    """For each block and segment it asked about: the least document id that has these
    bytes, and for the block of that document the parts that smaller ids have."""
    held = Bucket(asked)
    of, start, end, _ = held.intervals.later_parts()
    return [
        (block, 2, bucket, packed(held.least[w].astype("<i8")), packed(np.concatenate([k, s, e]).astype("<i4")))
        for block, w, k, s, e, _ in held.parts_by_block(of, start, end, True)
    ]


def answer_groups(bucket: int, asked: list[tuple]) -> list[tuple]:
    """For each block: every occurrence of every maximal repeat in the segments it asked
    about, with the repeat's digest (16 bytes each)."""
    import hashlib

    held = Bucket(asked)
    of, start, end = held.intervals.occurrences()
    whole = np.flatnonzero(held.repeated)
    parts = np.unique(np.stack([np.append(of, whole), np.append(start, np.zeros_like(whole)), np.append(end, held.sizes[whole])]), axis=1)
    base = np.cumsum(held.sizes) - held.sizes
    out = []
    for block, _, k, s, e, f in held.parts_by_block(*parts, False):
        at = base[f]
        digests = [hashlib.md5(held.text[a:z].tobytes()).digest() for a, z in zip((at + s).tolist(), (at + e).tolist(), strict=True)]
        out.append((block, 2, bucket, b"".join(digests), np.stack([k, s, e], axis=1).astype("<i4").tobytes()))
    return out


def apply_answers(block: Block, pieces: Pieces, second: dict[int, tuple[bytes, bytes]]) -> pa.Table:
    """doc_id, n_bytes, n_removed, n_spans and kept bytes of each document."""
    least = np.full(len(pieces.first), NO_ID, np.int64)
    rows = [np.zeros((0, 3), np.int64)]
    for bucket, a, z in pieces.parts:
        own, parts = second[bucket]
        least[a:z] = unpacked(own, "<i8")
        rows.append(unpacked(parts, "<i4").reshape(3, -1).T.astype(np.int64) + [a, 0, 0])
    later = pieces.ids > least[pieces.which]
    group, low, high = np.concatenate(rows).T
    # a part belongs to every piece of its group whose document is the least one
    edges = np.append(pieces.first, len(pieces.which))
    n = edges[group + 1] - edges[group] if len(group) else NONE
    piece = ranges(edges[group], n) if len(group) else NONE
    mine = ~later[piece]
    piece, low, high = piece[mine], np.repeat(low, n)[mine], np.repeat(high, n)[mine]
    start = np.concatenate([pieces.start[later], pieces.start[piece] + low])
    end = np.concatenate([pieces.end[later], pieces.start[piece] + high])
    order = np.argsort(start)
    start, end = start[order], end[order]
    doc = np.searchsorted(block.edges[1:], start, "right")
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.append(True, (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))[: len(start)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    start, end, doc = start[first], reach[last], doc[first]
    n_docs = len(block.id_of)
    n_spans = np.bincount(doc, minlength=n_docs)
    n_removed = np.bincount(doc, weights=end - start, minlength=n_docs).astype(np.int64)
    n_bytes = np.diff(block.edges)
    kept = np.ones(len(block.text), bool)
    kept[ranges(start, end - start)] = False
    offsets = np.append(0, np.cumsum(n_bytes - n_removed)).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), n_docs, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(block.text[kept].tobytes())])
    columns = [block.own_ids.combine_chunks(), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), texts.cast(pa.binary())]
    return pa.Table.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def apply_groups(block: Block, pieces: Pieces, second: dict[int, tuple[bytes, bytes]]) -> pa.Table:
    """Each occurrence of a maximal repeat: its digest, the document, start and end."""
    found = []
    edges = np.append(pieces.first, len(pieces.which))
    for bucket, a, _ in pieces.parts:
        digests, parts = second.get(bucket, (b"", b""))
        group, low, high = np.frombuffer(parts, "<i4").reshape(-1, 3).astype(np.int64).T
        n = edges[group + a + 1] - edges[group + a]
        piece = ranges(edges[group + a], n)
        names = np.frombuffer(digests, "V16")[np.repeat(np.arange(len(group)), n)]
        base = pieces.start[piece] - block.edges[pieces.doc[piece]]
        found.append((names, pieces.doc[piece], base + np.repeat(low, n), base + np.repeat(high, n)))
    if not found:
        found = [(np.zeros(0, "V16"), NONE, NONE, NONE)]
    names, doc, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    ids = block.own_ids.combine_chunks().take(pa.array(doc))
    return pa.Table.from_arrays([pa.array(names.tolist(), pa.binary()), ids, pa.array(start), pa.array(end)], names=["repeat", "doc_id", "start", "end"])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _repeats(
    docs: DataFrame, id_col: str, text_col: str, block_bytes: int, crowded: int, answer, apply, result: str
) -> DataFrame:
    spark = docs.sparkSession
    own = keyed(docs, id_col, text_col).select(
        "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")
    )
    total = own.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(n_tasks, int(total // block_bytes) + 1)
    n_buckets = max(n_tasks, int(total // (32 << 20)) + 1)
    dealt = own.select(F.pmod(F.xxhash64("doc_id", "raw"), F.lit(n_blocks)).cast("long").alias("block"), "doc_id", "raw")
    texts = dealt.mapInArrow(pack_texts, TEXTS).repartition(n_blocks, "block")
    schemas = {k: arrow_schema(spark, d) for k, d in (("a", ANCHORS), ("r", ANSWERS), ("b", BODIES), ("o", result))}

    def first(key, table):
        return _table(ask_anchors(key[0].as_py(), Block(unpack_texts(table), n_buckets)), schemas["a"])

    def first_answer(key, table):
        asked = table.column("block").to_pylist(), table.column("anchors").to_pylist()
        return _table(answer_anchors(key[0].as_py(), *asked, crowded), schemas["r"])

    def told(answers):
        got = answers.to_pylist()
        return [(r["bucket"], r["a"], r["b"]) for r in got if r["step"] == 1], {r["bucket"]: (r["a"], r["b"]) for r in got if r["step"] == 2}

    def second(key, table, answers):
        if not table.num_rows or not answers.num_rows:
            return _table([], schemas["b"])
        block = Block(unpack_texts(table), n_buckets)
        return _table(ask_bodies(key[0].as_py(), block, block.pieces(told(answers)[0])), schemas["b"])

    def second_answer(key, table):
        asked = list(zip(*(table.column(c).to_pylist() for c in ("block", "sizes", "least", "most", "bodies")), strict=True))
        return _table(answer(key[0].as_py(), asked), schemas["r"])

    def last(key, table, answers):
        block = Block(unpack_texts(table), n_buckets)
        one, two = told(answers)
        return apply(block, block.pieces(one), two).cast(schemas["o"])

    anchors = texts.groupBy("block").applyInArrow(first, ANCHORS)
    known = anchors.groupBy("bucket").applyInArrow(first_answer, ANSWERS)
    bodies = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(second, BODIES)
    parts = bodies.groupBy("bucket").applyInArrow(second_answer, ANSWERS)
    return texts.groupBy("block").cogroup(known.unionByName(parts).groupBy("block")).applyInArrow(last, result)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, crowded: int = CROWDED
) -> DataFrame:
    """One row per input row: doc_id, n_bytes of its UTF-8 text, n_removed and n_spans
    (maximal runs) of the bytes that some 50-byte string covers which also starts in a
    document of smaller doc_id, and kept, the other bytes in order.

    Null texts are empty. Null ids come after all others. Repeated rows of one id do not
    remove each other. Texts under 50 bytes lose nothing. An empty table gives an empty
    result; other columns are ignored. A task holds one block of documents, or one
    bucket of segments.
    """
    return _repeats(docs, id_col, text_col, block_bytes, crowded, answer_bodies, apply_answers, RESULT)


def repeat_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, crowded: int = CROWDED
) -> DataFrame:
    """The maximal repeat groups behind remove_repeats, one row per occurrence: repeat
    (the MD5 of its bytes), doc_id, start and end (bytes, end exclusive) in its text.

    Groups are those of the segments around one anchor, 50 to 84 bytes: a longer repeat
    comes as a chain of overlapping groups. A repeat that stands in one document only is
    no group. Nulls, repeated ids, short texts and empty tables: as for remove_repeats.
    """
    return _repeats(docs, id_col, text_col, block_bytes, crowded, answer_groups, apply_groups, GROUPS)
