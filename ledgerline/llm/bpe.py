"""Operator 8: byte-level BPE by a sentencepiece model made from a rank file.

The model is serialised here from the vocabulary: each token's bytes are spelled with one
printable character per byte, its score is its negative rank, and the normaliser is the
identity. Merging the best-scored pair first is then the same as merging the lowest rank
first. Texts are cut into pre-tokens, each is encoded apart, and ids are turned back by
the inverse of the byte spelling.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, map_batches, texts_of

#: Units whose ids a worker remembers, and the longest of them in characters.
CACHED, CACHED_LENGTH = 600_000, 48
#: Characters that are encoded together.
BLOCK = 1 << 20
#: A word with the space before it, or a single separator. Where no two white-space
#: characters meet, pre-tokens never cross these units.
UNIT = re.compile(r" ?[^ \n]+|[ \n]")
WIDE_SPACE = re.compile(r"\s\s")


def byte_spelling() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else one
    from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks. Ranks must run from
    0 without gaps. One unknown piece follows them, as the format demands one."""
    spell = byte_spelling()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    pieces = [
        _bytes_field(1, "".join(spell[b] for b in t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(i))
        for i, t in enumerate(tokens)
    ]
    pieces.append(_bytes_field(1, b"<unk>") + _int_field(3, 2))
    trainer = (
        _int_field(3, 2)  # BPE
        + _int_field(4, len(pieces))
        + _int_field(40, len(tokens))  # unknown
        + b"".join(_int_field(k, -1) for k in (41, 42, 43))  # no begin, end, padding
    )
    normalizer = _bytes_field(1, b"identity") + b"".join(_int_field(k, 0) for k in (3, 4, 5))
    return b"".join(_bytes_field(1, p) for p in pieces) + _bytes_field(2, trainer) + _bytes_field(3, normalizer)


class Codec:
    """Encodes texts to ids and back."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        spell = byte_spelling()
        self.spell = {b: c for b, c in enumerate(spell)}
        unspell = {c: b for b, c in enumerate(spell)}
        self.bytes_of = [
            bytes(unspell[c] for c in self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)
        ]
        self.id_of = {self.model.id_to_piece(i): i for i in range(len(ranks))}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of each unit: of its pre-tokens, each encoded apart, in order."""
        words = {u for u in units if u.isascii() and u.lstrip(" ").isalpha()}  # one pre-token each
        split = {u: self.split(u) for u in units.difference(words)}
        new = sorted(words.union(*split.values()))
        spelled = [
            p.replace(" ", self.spell[32]) if p.isascii() and p.isprintable()
            else p.encode().decode("latin-1").translate(self.spell)
            for p in new
        ]
        ids = {}
        for p, s, found in zip(new, spelled, self.model.encode(spelled, out_type=int, num_threads=1), strict=True):
            whole = self.id_of.get(s)
            ids[p] = struct.pack(f"<{len(found)}I", *found) if whole is None else struct.pack("<I", whole)
        for u, ps in split.items():
            ids[u] = ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps))
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        units = [self.split(t) if WIDE_SPACE.search(t) else UNIT.findall(t) for t in texts]
        new = set().union(*units).difference(self.known)
        found = self._learn(new)
        if len(self.known) + len(found) > CACHED:
            self.known = {u: self.known[u] for u in set().union(*units) if u in self.known}
        known = self.known
        known.update(found)
        out = [b"".join(map(known.__getitem__, us)) for us in units]
        for u in found:
            if len(u) > CACHED_LENGTH:
                del known[u]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of about BLOCK characters."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit).

    ranks_path must be readable on every executor. Null texts are empty and have no ids.
    Null ids and repeated rows are kept as they are; an empty table gives an empty
    result; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        encode, ids = codec(ranks_path, pattern).encode, []
        for block in blocks(texts_of(batch.column("text"))):
            ids += encode(block)
        return {"doc_id": batch.column("doc_id"), "ids": ids}

    return map_batches(keyed(docs, id_col, text_col), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The inverse of encode_documents: doc_id, ids, decoded (binary). Null ids decode to
    nothing."""

    def run(batch: pa.RecordBatch) -> dict:
        decode = codec(ranks_path, pattern).decode
        ids = batch.column("ids").to_pylist()
        return {
            "doc_id": batch.column("doc_id"),
            "ids": batch.column("ids"),
            "decoded": [decode(x or b"") for x in ids],
        }

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """encode_documents and decode_documents in one Arrow map, so that a task needs one
    worker with one model: doc_id, ids, decoded. Nulls, repeated rows and empty tables as
    in encode_documents."""

    def run(batch: pa.RecordBatch) -> dict:
        own, ids, decoded = codec(ranks_path, pattern), [], []
        for block in blocks(texts_of(batch.column("text"))):
            found = own.encode(block)
            ids += found
            decoded += map(own.decode, found)
        return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": decoded}

    return map_batches(keyed(docs, id_col, text_col), run, "doc_id long, ids binary, decoded binary")
