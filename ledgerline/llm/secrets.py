"""Operator 2: secret scans through nested encodings.

A document is the first layer of a worklist. Each layer is scanned for secrets, then
decoded in every way that applies: percent escapes, Unicode escapes, base64 runs (in
each alignment, joined over line breaks, and as UTF-16), octal escapes, and gzip, zlib or
raw deflate streams inside base64, inside escaped bytes or inside each other. Of a damaged
stream all is read that comes before the damage. Every decoded text is a further layer, until nothing new appears. Layers carry, for each of their characters, the span of the document that
it came from, so that what is found in any layer is reported as a span of the document.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_batches, texts_of

#: Kinds in their order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_HINTS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|(?:\\[0-3][0-7]{2})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: Escaped bytes among plain characters, which stand for themselves: bytes, not all of
#: them text, in URLs (no white space or quotes inside) and in string literals (to the line's end).
URL_BYTES = re.compile(r"[^\s%]?(?:%[0-9A-Fa-f]{2}[^\s%\"'<>]*+)+")
LITERAL_BYTES = re.compile(r"[^\s\\]?(?:\\(?:x[0-9A-Fa-f]{2}|[0-3][0-7]{2}|[abfnrtv0\\'\"])[^\r\n\\]*+)+")
ONE_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\([0-3][0-7]{2})|\\(.)|([\s\S])")
BYTE_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|[0-3][0-7]{2})")
LETTERS = dict(zip("abfnrtv0\\'\"", b"\x07\x08\x0c\n\r\t\x0b\x00\\'\"", strict=True))
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64: runs that reach the line's end and go on in the next line.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
BREAKS = re.compile(r"[ \t]*\r?\n[ \t]*")
URL_SAFE = str.maketrans("-_", "+/")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: The shortest secret, and what may be readable in bytes or in their text with escapes.
LEAST = len("token=") + MIN_ASSIGNED
PRINTED = re.compile(rb"[\t\n\r\x20-\x7e\x80-\xff]{%d}" % LEAST)
STRETCH = re.compile(r"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\udc80-\udcff]{%d,}" % LEAST)
#: The same in UTF-16, of either byte order.
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}|(?:\x00[\t\n\r\x20-\x7e]){%d,}" % (LEAST, LEAST))
#: Bytes that pieces of a long stream share, and those that are fed to it at once.
OVERLAP, FEED = 1 << 20, 1 << 16
#: Pieces that are read at most of one stream with all that is in it.
MOST_PIECES = 64
#: A damaged stream with a zlib header counts as one if it held so much text; fewer bytes,
#: or others, come out of chance headers too.
LEAST_INFLATED = 32
GZIP = b"\x1f\x8b\x08"


def _zlib_headers() -> bytes:
    """A pattern of the two bytes that begin a zlib stream without a preset dictionary:
    deflate with a window of 256 bytes to 32 KB, and the pair a multiple of 31."""
    flags = {m: [f for f in range(256) if (256 * m + f) % 31 == 0 and not f & 32] for m in range(0x08, 0x80, 0x10)}
    return b"|".join(b"\\x%02x[%s]" % (m, b"".join(b"\\x%02x" % f for f in fs)) for m, fs in flags.items())


MAGIC = re.compile(re.escape(GZIP) + b"|" + _zlib_headers())


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text: leftmost non-overlapping matches of each kind."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    # a run of 24 or more is the whole maximal run, as shorter ones can't begin one
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


@dataclass
class Layer:
    text: str
    path: tuple[str, ...] = ()
    #: where each character comes from in the document; None: from itself
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    #: bytes left for the stream that it comes from and all inside it; None: from none
    left: list[int] | None = None

    def span(self, s: int, e: int) -> tuple[int, int]:
        if self.start is None:
            return s, e
        return int(self.start[s]), int(self.end[e - 1])

    def outer(self, s: int, e: int) -> tuple[int, int]:
        return tuple(map(int, self.span(s, e)))

    def child(self, how: str, text: str, start: np.ndarray, end: np.ndarray) -> Layer:
        """start, end: in this layer's characters."""
        if self.start is not None:
            start, end = self.start[start], self.end[end - 1]
        return Layer(text, (*self.path, how), start, end, self.left)


@dataclass
class Room:
    """How streams of one document are read: most bytes in one piece and of one stream with
    all inside it, and the spans of those that were not read as a whole."""

    most: int
    each: int
    unread: set[tuple[int, int]] = field(default_factory=set)
    known: set[tuple] = field(default_factory=set)
    #: (way, start, end) of damaged streams and of those read to their end
    damaged: set[tuple] = field(default_factory=set)
    whole: set[tuple] = field(default_factory=set)

    def not_whole(self) -> list[tuple[int, int]]:
        """Spans not read as a whole. A line of a wrapped stream breaks off, but isn't
        damaged where the stream is read over all its lines."""
        furthest: dict[tuple, int] = {}
        for way, start, end in self.whole:
            furthest[way, start] = max(end, furthest.get((way, start), 0))
        return sorted(self.unread | {(s, e) for way, s, e in self.damaged if furthest.get((way, s), 0) <= e})


def _escape(run: str) -> str | None:
    try:
        if run[0] == "&":
            return chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1]))
        if run[1] == "x":
            return bytes.fromhex(run.replace("\\x", "")).decode("utf-8")
        if run[1].isdigit():
            return bytes(int(o, 8) for o in run.split("\\")[1:]).decode("utf-8")
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16))
        if run[1] == "U":
            return chr(int(run[2:], 16))
        return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be")
    except (ValueError, OverflowError):
        return None


def _widths(run: str, decoded: str) -> list[int]:
    """How many characters of the run each decoded character took."""
    if run[0] == "%":
        return [3 * len(c.encode()) for c in decoded]
    if run.startswith("\\x") or run[0] == "\\" and run[1].isdigit():
        return [4 * len(c.encode()) for c in decoded]
    if run[:2] == "\\u" and run[2] != "{":
        return [12 if ord(c) > 0xFFFF else 6 for c in decoded]
    return [len(run)]


def _replaced(layer: Layer, how: str, pattern: re.Pattern, decode) -> Layer | None:
    """A layer in which every run of the pattern that decodes is decoded."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        decoded = decode(m[0])
        if not decoded or any(0xD800 <= ord(c) < 0xE000 for c in decoded):
            continue
        changed = True
        parts += [layer.text[at : m.start()], decoded]
        edge = m.start() + np.cumsum([0, *_widths(m[0], decoded)])
        starts += [np.arange(at, m.start()), edge[:-1]]
        ends += [np.arange(at + 1, m.start() + 1), edge[1:]]
        at = m.end()
    if not changed:
        return None
    n = len(layer.text)
    parts.append(layer.text[at:])
    starts.append(np.arange(at, n))
    ends.append(np.arange(at + 1, n + 1))
    return layer.child(how, "".join(parts), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode("utf-8")
    except ValueError:
        return None


def _before_damage(d, feed: memoryview, most: int) -> bytes:
    """What comes out of a stream up to the byte that breaks it."""
    out = bytearray()
    try:
        for k in range(len(feed)):
            out += d.decompress(feed[k : k + 1])
            if len(out) > most:
                break
    except zlib.error:
        pass
    return bytes(out)


def _inflate(raw: bytes, at: int, most: int, kind: int = 47) -> Iterator[tuple[bytes, int | None, bool]]:
    """The data of the gzip or zlib stream at a place and of all gzip members that follow
    it, with where they end, and whether they are undamaged: in one piece if that is at
    most most bytes, else in pieces of most bytes that overlap, each but the last with None.
    A stream that breaks off or is damaged ends with raw. kind: as zlib's wbits."""
    held, ended, whole = bytearray(), None, True
    while whole:
        d, left = zlib.decompressobj(kind), memoryview(raw)[at:]
        while not d.eof:
            feed, most_now = left[:FEED], max(1, most + 1 - len(held))
            safe = d.copy()
            try:
                got = d.decompress(feed, most_now)
                left = left[len(feed) - len(d.unconsumed_tail) - len(d.unused_data) :]
            except zlib.error:
                got, whole = _before_damage(safe, feed, most), False
            held += got
            if len(held) > most:
                yield bytes(held), None, True
                held = held[-min(OVERLAP, most // 2) :]
            if not whole or not left and not got and not d.eof:
                break
        whole = whole and d.eof
        if whole:
            ended = at = len(raw) - len(left)
            if not raw.startswith(GZIP, at):
                break
    yield bytes(held), ended if whole else len(raw), whole


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except ValueError:
        return None
    return text if text and not CONTROL.search(text) else None


def _texts(raw: bytes) -> bool:
    """Whether bytes are text, nine in ten at least."""
    return 10 * sum(map(len, re.findall(rb"[\t\n\r\x20-\x7e]+", raw))) >= 9 * len(raw) or not CONTROL.search(raw.decode("utf-8", "replace").rstrip("\ufffd").replace("\ufffd", "\0"))


def _sizes(text: str) -> np.ndarray:
    if text.isascii():
        return np.ones(len(text), np.int64)
    return np.fromiter((len(c.encode("utf-8", "surrogateescape")) for c in text), np.int64, len(text))


def _wide_stretches(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """As _stretches, of UTF-16."""
    for m in WIDE.finditer(raw):
        low = m[0][0] != 0
        first = np.arange(m.start(), m.end(), 2)
        yield m[0][not low :: 2].decode(), first, first + 1


def _stretches(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The readable stretches of bytes that are long enough for a secret, with the first
    and last byte of each character; the whole, where it is readable."""
    if b"\x00" in raw:
        yield from _wide_stretches(raw)
    whole = _readable(raw)
    if whole is None and not PRINTED.search(raw):
        return
    text = raw.decode("utf-8", "surrogateescape") if whole is None else whole
    spans = [(0, len(text))] if whole is not None else [m.span() for m in STRETCH.finditer(text)]
    if spans:
        size = _sizes(text)
        last = np.cumsum(size) - 1
        for a, z in spans:
            yield text[a:z], last[a:z] - size[a:z] + 1, last[a:z]


def _deflated(raw: bytes, most: int) -> bytes | None:
    """What raw holds, if all of it is one raw deflate stream with room for a secret."""
    d = zlib.decompressobj(-15)
    try:
        plain = d.decompress(raw, most + 1)
    except zlib.error:
        return None
    return plain if d.eof and not d.unused_data and LEAST <= len(plain) <= most else None


def _compressed_layers(layer: Layer, raw: bytes, how: str, place, room: Room) -> Iterator[Layer]:
    """The layers of all streams in raw, and of streams in what they hold. place(first,
    last byte) is a stream's span in the layer."""

    def inside(raw: bytes, how: str, span: tuple | None, left: list[int] | None) -> Iterator:
        """Layers, and iterators like this one over what a stream holds."""
        at = 0
        deflated = span is None and _deflated(raw, room.most)
        if deflated:
            yield from read(raw, how, place(0, len(raw) - 1), left or [room.each], [(deflated, len(raw), True)], True)
        while m := MAGIC.search(raw, at):
            at = m.start() + 1
            certain = m[0] == GZIP
            ends: list[int] = []
            pieces = ((x, (ends.append(e) or e) if e and ok else e, ok) for x, e, ok in _inflate(raw, m.start(), room.most))
            own = span or (lambda end, start=m.start(): place(start, end - 1))
            yield from read(raw, how, own, left or [room.each], pieces, certain)
            at = max([at, *ends])

    def read(raw: bytes, how: str, own, left: list[int], pieces, certain: bool) -> Iterator:
        """The layers of one stream's pieces (data, end or None, undamaged)."""
        n_bytes = 0
        for plain, end, undamaged in pieces:
            where = own(end or len(raw)) if callable(own) else own
            outer = layer.outer(*where)
            n_bytes += len(plain)
            left[0] -= len(plain)
            if end is None or left[0] < 0:
                room.unread.add(outer)
            elif undamaged:
                room.whole.add((how, *outer))
            elif certain or n_bytes >= LEAST_INFLATED and _texts(plain[:4096]):
                room.damaged.add((how, *outer))
            if left[0] < 0:
                return
            if not plain:
                continue
            for text, first, _ in _stretches(plain):
                n = len(first)
                found = layer.child(how, text, np.full(n, where[0]), np.full(n, where[1]))
                found.left = left
                yield found
            key = (hashlib.blake2b(plain, digest_size=16).digest(), *outer)
            if key not in room.known:  # a stream can hold itself
                room.known.add(key)
                yield inside(plain, f"{how}>compressed", where, left)

    way = [inside(raw, how, None, layer.left)]
    while way:
        x = next(way[-1], None)
        if x is None:
            way.pop()
        elif isinstance(x, Layer):
            yield x
        else:
            way.append(x)


def _base64_layers(layer: Layer, room: Room) -> Iterator[Layer]:
    """The layers of the base64 runs."""
    runs = [(m, None) for m in BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        runs += [(m, BREAKS) for m in WRAPPED.finditer(layer.text)]
    for m, breaks in runs:
        run, at = m[0].rstrip("="), np.arange(m.start(), m.end())
        if breaks:
            inside = np.ones(len(run), bool)
            for b in breaks.finditer(run):
                inside[b.start() : b.end()] = False
            run, at = breaks.sub("", run), at[: len(run)][inside]
        run = run.translate(URL_SAFE)
        for skip in range(4):  # glued to other characters, a value begins anywhere
            n = len(run) - skip
            n -= n % 4 == 1
            if n < 16:
                break
            raw = base64.b64decode(run[skip : skip + n] + "=" * (-n % 4))

            # byte k of the data lies in characters 4k/3 and the next one of the run
            def place(first, last, skip=skip, at=at):
                return at[skip + first // 3 * 4 + first % 3], at[skip + last // 3 * 4 + last % 3 + 1] + 1

            def stream(first, last, skip=skip, size=len(raw), m=m, place=place):
                return m.span() if skip == first == 0 and last == size - 1 else place(first, last)

            yield from _compressed_layers(layer, raw, "base64>compressed", stream, room)
            for text, first, last in _stretches(raw):
                yield layer.child("base64", text, *place(first, last))
            if skip == 0 and _readable(raw) is not None:
                break


def _escaped_layers(layer: Layer, room: Room) -> Iterator[Layer]:
    """The layers of escaped bytes that aren't text as a whole: readable stretches of them,
    and of the streams inside."""
    for how, mark, pattern in (("url", PERCENT, URL_BYTES), ("unicode", BYTE_ESCAPE, LITERAL_BYTES)):
        if not mark.search(layer.text):
            continue
        for m in pattern.finditer(layer.text):
            if not mark.search(m[0]):
                continue
            parts, sizes, widths = [], [], []
            for one in ONE_BYTE.finditer(m[0]):
                code = one[1] if how == "url" else one[2]
                octal, letter = one.group(3, 4) if how == "unicode" else (None, None)
                if code:
                    part = bytes.fromhex(code)
                elif octal:
                    part = bytes([int(octal, 8)])
                elif letter in LETTERS:
                    part = bytes([LETTERS[letter]])
                else:
                    part = one[0].encode("utf-8", "surrogatepass")
                parts.append(part)
                sizes.append(len(part))
                widths.append(len(one[0]))
            raw = b"".join(parts)
            if _readable(raw) is not None and not MAGIC.search(raw):
                continue  # whole text, which is a layer of its own
            end = m.start() + np.cumsum(widths)
            start, end = np.repeat(end - widths, sizes), np.repeat(end, sizes)

            def place(first, last, start=start, end=end):
                return start[first], end[last]

            yield from _compressed_layers(layer, raw, f"{how}>compressed", place, room)
            for text, first, last in _stretches(raw):
                yield layer.child(how, text, *place(first, last))


@dataclass
class Found:
    """What one document holds: (kind, start, end, path) with path '' for its own text;
    and the spans of compressed runs that were read in pieces, or not to their end."""

    rows: list[tuple[str, int, int, str]] = field(default_factory=list)
    n_layers: int = 1
    truncated: bool = False
    unread: list[tuple[int, int]] = field(default_factory=list)


def _layers(layer: Layer, room: Room) -> Iterator[Layer]:
    if "%" in layer.text and (x := _replaced(layer, "url", PERCENT, _percent)):
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := _replaced(layer, "unicode", ESCAPES, _escape)):
        yield x
    yield from _escaped_layers(layer, room)
    yield from _base64_layers(layer, room)


def unwrap(text: str, max_expanded: int) -> Found:
    """Layers are followed in depth, so that only those on the way to one are held; none
    is left out but the rest of a stream that expands, with all inside it, beyond
    MOST_PIECES pieces. Every stream of the document has pieces of its own."""
    out, seen, known = Found(), set(), set()
    most = max(max_expanded, 4 * len(text))
    room = Room(most, MOST_PIECES * most)
    way = [iter([Layer(text)])]
    while way:
        layer = next(way[-1], None)
        if layer is None:
            way.pop()
            continue
        if layer.path:
            raw = layer.text.encode("utf-8", "surrogatepass")
            key = (hashlib.blake2b(raw, digest_size=16).digest(), *layer.outer(0, len(layer.text)))
            if key in known:  # a cycle, or the same run met by way of another layer
                continue
            known.add(key)
            out.n_layers += 1
        for kind, s, e in scan(layer.text):
            span = (kind, *layer.span(s, e))
            if span not in seen:
                seen.add(span)
                out.rows.append((*span, ">".join(layer.path)))
        way.append(_layers(layer, room))
    out.unread = room.not_whole()
    out.truncated = bool(out.unread)
    return out


FINDINGS = "array<struct<kind:string,start:long,end:long,path:string>>"


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_expanded: int = 64 << 20
) -> DataFrame:
    """One row per input row: doc_id, findings (kind, start, end in code points of the
    document, path of decoders, '' for the text itself), n_layers, truncated.

    Whole texts are scanned; null texts are empty and have no findings. max_expanded (at
    least four times the document's length) bounds the bytes of a compressed stream that
    are held at once: a longer one is read in overlapping pieces, up to MOST_PIECES of them
    with all inside it. truncated is true if a stream was not read in one piece to its end,
    or is damaged. No other layer is bounded. Null ids and
    repeated rows are kept as they are; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = [unwrap(t, max_expanded) for t in texts_of(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"),
            "findings": [
                [{"kind": k, "start": s, "end": e, "path": p} for k, s, e, p in f.rows] for f in found
            ],
            "n_layers": [f.n_layers for f in found],
            "truncated": [f.truncated for f in found],
        }

    return map_batches(
        keyed(docs, id_col, text_col), run, f"doc_id long, findings {FINDINGS}, n_layers int, truncated boolean"
    )


def spans_text(findings: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, then end; comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(
        F.transform(
            findings,
            lambda f: F.struct(f["start"].alias("s"), rank[f["kind"]].alias("r"), f["end"].alias("e"), f["kind"].alias("k")),
        )
    )
    return F.concat_ws(",", F.transform(ordered, lambda f: F.concat_ws(":", f["k"], f["s"], f["e"])))


def secret_report(found: DataFrame) -> DataFrame:
    """scan_secrets() rows as counts and digests."""
    own = F.filter("findings", lambda f: f["path"] == "")
    count = lambda kind: F.size(F.filter(own, lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spans_text(own), 256).alias("base_sha256"),
        spans_text(F.col("findings")).alias("spans"),
        "n_layers",
        "truncated",
    )


def redact(text: str, rows: list[tuple[str, int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every found span, overlapping ones merged, replaced by mark."""
    out, upto = [], 0
    for s, e in sorted((s, e) for _, s, e, _ in rows):
        if not out or s >= upto:
            out += [text[upto:s], mark]
        upto = max(upto, e)
    return "".join([*out, text[upto:]])
