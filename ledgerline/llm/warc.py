"""Operator 6: WARC archives in seekable Zstandard bundles.

Each writing task makes one bundle: records are grouped into frames of about FRAME_BYTES
and at most FRAME_RECORDS (revisits are short, and frames are what reading tasks are
dealt), every frame is compressed by itself, and a seek table in a skippable frame at the end of
the file lists all frames. An index table maps each record to its bundle, its frame, and
its offset inside the decompressed frame, so that one record costs one frame to read.

Bundles get names that no other attempt of the task uses, and only the index says which
bundles count: a task that ran twice leaves a file that nothing points to.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, saved, to_batch, work_dir

FRAME_BYTES = 1 << 20
FRAME_RECORDS = 64
#: Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, size long"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of another page's payload. A revisit keeps the
    HTTP header, whose Content-Length is the payload's, and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": urn(refers_to), "WARC-Profile": PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of a record and of its HTTP message, and the payload (None for revisits)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.decode().split(": ", 1) for x in head.split(b"\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.decode().split(": ", 1) for x in http.split(b"\r\n")[1:])
    return {"warc": warc, "http": fields, "payload": payload if warc["WARC-Type"] == "response" else None}


class BundleWriter:
    """Writes records into a seekable Zstandard stream."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.level = stream, zstandard.ZstdCompressor(level=level)
        self.frame, self.records, self.frames = bytearray(), 0, []

    def add(self, raw: bytes) -> tuple[int, int]:
        """The record's frame and its offset in that frame."""
        if self.frame and (len(self.frame) + len(raw) > FRAME_BYTES or self.records == FRAME_RECORDS):
            self.flush()
        at = len(self.frames), len(self.frame)
        self.frame += raw
        self.records += 1
        return at

    def flush(self) -> None:
        if self.frame:
            packed = self.level.compress(bytes(self.frame))
            self.stream.write(packed)
            self.frames.append((len(packed), len(self.frame)))
            self.frame.clear()
            self.records = 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Reads single frames by the seek table at the end of the file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        table = file.read_at(n * entry, size - 9 - n * entry)
        self.starts, self.sizes, at = [], [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.starts.append(at)
            self.sizes.append((packed, plain))
            at += packed
        self.last: tuple[int, bytes] | None = None

    def frame(self, k: int) -> bytes:
        import zstandard

        if self.last is None or self.last[0] != k:
            packed, plain = self.sizes[k]
            raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[k]), plain)
            self.last = k, raw
        return self.last[1]


def _filesystem(uri: str):
    """The file system and the path of a folder: an absolute path, or a URI of a scheme that
    pyarrow knows (file, hdfs, viewfs, s3, gs). Others are a ValueError."""
    from pyarrow.fs import FileSystem

    try:
        return FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archives can't be kept in {uri}: {e}") from e


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload and the page_id that a revisit refers to. Payload groups are
    reduced to one row each before the join, which skewed digests can't unbalance beyond
    what adaptive execution splits."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.when(F.octet_length("payload") >= MIN_REVISIT_BYTES, F.sha1("payload")))
    groups = (
        rows.where("digest is not null")
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return rows.join(groups, rows.digest == groups["_digest"], "left").select(
        "page_id", "url", "payload", refers.alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row into bundles under folder (a URI that all executors
    share) and returns the index, read from where it was written: page_id, record_id,
    bundle, frame, offset, size.

    Null payloads are empty. Of rows with equal payloads of at least 1000 bytes those
    with the largest page_id are responses (so are repeated rows of that id, and all rows
    of a group without ids); the others are revisits. Null ids are kept. An empty table
    writes no bundle. Other columns are ignored.
    """
    schema = arrow_schema(pages.sparkSession, INDEX)
    _filesystem(folder)  # fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        name, writer, rows = f"{uuid.uuid4().hex}.warc.zst", None, []
        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                page_id = page_id.as_py()
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    writer = BundleWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                raw = record(page_id, url.as_py(), payload.as_py(), refers.as_py(), date)
                rows.append((page_id, urn(page_id), name, *writer.add(raw), len(raw)))
        if writer is not None:
            writer.close()
            yield to_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return saved(mark_revisits(pages, id_col, url_col, html_col).mapInArrow(run, INDEX), "warc-index")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of an index point to, by seek table and frame offset.
    payload_digest is bare lower-case hex: computed from a response's payload, taken from
    the header of a revisit, whose payload is null."""
    schema = arrow_schema(index.sparkSession, RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        name, reader = None, None
        for batch in batches:
            rows = []
            for bundle, frame, offset, size in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "size")), strict=True):
                if bundle != name:
                    name, reader = bundle, BundleReader(fs.open_input_file(f"{path}/{bundle}"))
                rows.append(_row(parse_record(reader.frame(frame)[offset : offset + size])))
                if len(rows) >= 1000:
                    yield to_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)
                    rows = []
            if rows:
                yield to_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(run, RECORDS)


def _row(found: dict) -> tuple:
    warc, payload = found["warc"], found["payload"]
    refers = warc.get("WARC-Refers-To")
    stated = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:"))
    digest = stated if payload is None else hashlib.sha1(payload).digest()
    if digest != stated:
        raise ValueError(f"{warc['WARC-Record-ID']}: the payload does not have its digest")
    return (
        page_of(warc["WARC-Record-ID"]),
        warc["WARC-Target-URI"],
        int(found["http"]["Content-Length"]) if payload is None else len(payload),
        digest.hex(),
        warc["WARC-Type"],
        None if refers is None else page_of(refers),
        payload,
    )


def frames_of(raw: bytes) -> list[bytes]:
    """All frames of a bundle held in memory, in order."""
    reader = BundleReader(_InMemory(raw))
    return [reader.frame(k) for k in range(len(reader.sizes))]


class _InMemory:
    def __init__(self, raw: bytes):
        self.raw = io.BytesIO(raw)

    def size(self) -> int:
        return len(self.raw.getbuffer())

    def read_at(self, n: int, at: int) -> bytes:
        self.raw.seek(at)
        return self.raw.read(n)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to the shared folder and reads every record back."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder).drop("payload")
