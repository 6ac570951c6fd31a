"""Declared digests: validity, subresource-integrity lists, canonical SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lower, trim

#: Hexadecimal digits of each algorithm's digest.
DIGEST_LENGTHS = {"SHA-1": 40, "SHA-256": 64, "SHA-384": 96, "SHA-512": 128}
MAX_FIELD_BYTES = 4096


def is_valid_hash(h: Column) -> Column:
    """A struct (algorithm, digest, subject, source_artifact, source_parser) whose digest
    has its algorithm's length and whose other fields are bounded, without controls."""
    shape = F.lit(False)
    for name, n in DIGEST_LENGTHS.items():
        shape = shape | ((h["algorithm"] == name) & h["digest"].rlike(rf"^[0-9a-f]{{{n}}}\z"))
    for f in ("subject", "source_artifact", "source_parser"):
        shape = shape & (F.octet_length(h[f]) <= MAX_FIELD_BYTES) & ~h[f].rlike(r"[\x00-\x1F\x7F]")
    return shape & (h["source_artifact"] != "") & (h["source_parser"] != "")


def sri_hashes(text: Column) -> Column:
    """array<struct<algorithm,digest>> of the valid tokens of a subresource-integrity
    list: known algorithm, canonical base64 of exactly its length; options are cut."""

    def token(t: Column) -> Column:
        t = F.split_part(t, F.lit("?"), F.lit(1))
        algorithm = F.regexp_extract(t, r"^sha(1|256|384|512)-", 1)
        encoded = F.regexp_extract(t, r"^sha(?:1|256|384|512)-([A-Za-z0-9+/]+={0,2})\z", 1)
        raw = F.try_to_binary(encoded, F.lit("base64"))
        right = F.lit(False)
        for name, n in DIGEST_LENGTHS.items():
            right = right | ((algorithm == name[4:]) & (F.octet_length(raw) == n // 2))
        ok = right & (F.replace(F.base64(raw), F.lit("\r\n"), F.lit("")) == encoded)
        return F.when(ok, F.struct(F.concat(F.lit("SHA-"), algorithm).alias("algorithm"), lower(F.hex(raw)).alias("digest")))

    return F.filter(F.transform(F.split(trim(text), r"[\x00-\x20]+"), token), lambda t: t.isNotNull())


def canonical_sha256(text: Column) -> Column:
    value = trim(text)
    return F.when(value.rlike(r"^[0-9A-Fa-f]{64}\z"), lower(value)).otherwise("")
