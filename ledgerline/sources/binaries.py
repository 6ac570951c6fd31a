"""What executables, libraries and archives state about themselves, read from their bytes
with bounds on every offset. Tasks read each file's own bytes; nothing is executed."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import native_library_version

#: Machine numbers of the formats.
PE_MACHINES = {0x14C: "x86", 0x8664: "x86_64", 0xAA64: "arm64", 0x1C0: "arm", 0x1C4: "arm"}
ELF_MACHINES = {3: "x86", 40: "arm", 62: "x86_64", 183: "arm64", 243: "riscv", 20: "powerpc", 21: "powerpc64", 22: "s390"}
MACH_CPUS = {7: "x86", 0x01000007: "x86_64", 12: "arm", 0x0100000C: "arm64", 18: "powerpc"}
MACH_TYPES = {1: "object", 2: "executable", 6: "library", 8: "library"}
DYLIB_COMMANDS = {0xC, 0x80000018, 0x8000001F, 0x20, 0x80000023}
MAX_NAMES, MAX_HEADERS, MAX_DYNAMIC = 4096, 1024, 16384
MAX_RESOURCES, MAX_VERSION_BYTES, MAX_VERSION_BLOCKS = 8192, 1 << 20, 4096
VERSION_RESOURCE, FIXED_INFO = 16, 0xFEEF04BD
STATED = ("file_version", "product_version", "company_name", "product_name")
BINARY = (
    "struct<format:string,architecture:string,kind:string,needed:array<string>,soname:string,build_id:string,diagnostic:string,"
    "file_version:string,product_version:string,company_name:string,product_name:string>"
)
ARCHIVE = "array<struct<group_id:string,artifact_id:string,version:string,title:string,path:string>>"
MAX_ENTRIES, MAX_METADATA_BYTES, MAX_METADATA = 32768, 2 << 20, 128


class Bytes:
    """Range-checked reads of either byte order."""

    def __init__(self, raw: bytes, order: str = "<"):
        self.raw, self.order = raw, order

    def get(self, at: int, kind: str) -> int:
        size = struct.calcsize(kind)
        if at < 0 or at + size > len(self.raw):
            raise ValueError("a field lies outside of the file")
        return struct.unpack_from(self.order + kind, self.raw, at)[0]

    def text(self, at: int, limit: int = 4096) -> str:
        if at < 0 or at >= len(self.raw):
            raise ValueError("a name lies outside of the file")
        end = self.raw.find(b"\0", at, at + limit)
        if end < 0:
            raise ValueError("a name has no end")
        return self.raw[at:end].decode("utf-8", "replace")


def _result(fmt: str, architecture: str, kind: str, needed=(), soname="", build_id="", diagnostic="", **stated: str) -> dict:
    return {
        "format": fmt, "architecture": architecture, "kind": kind, "needed": list(dict.fromkeys(needed))[:MAX_NAMES],
        "soname": soname, "build_id": build_id, "diagnostic": diagnostic, **{k: stated.get(k, "") for k in STATED},
    }


def elf(raw: bytes) -> dict:
    wide = raw[4:5] == b"\x02"
    b = Bytes(raw, "<" if raw[5:6] == b"\x01" else ">")
    kind, machine = b.get(16, "H"), b.get(18, "H")
    at, size, count = (b.get(32, "Q"), b.get(54, "H"), b.get(56, "H")) if wide else (b.get(28, "I"), b.get(42, "H"), b.get(44, "H"))
    if count > MAX_HEADERS:
        raise ValueError("too many program headers")
    loads, dynamic, notes, interpreted = [], None, [], False
    for i in range(count):
        p = at + i * size
        t = b.get(p, "I")
        offset, address, length = (b.get(p + 8, "Q"), b.get(p + 16, "Q"), b.get(p + 32, "Q")) if wide else (b.get(p + 4, "I"), b.get(p + 8, "I"), b.get(p + 16, "I"))
        if t == 1:
            loads.append((address, offset, length))
        elif t == 2:
            dynamic = (offset, length)
        elif t == 3:
            interpreted = True
        elif t == 4:
            notes.append((offset, length))
    name = {1: "object", 2: "executable", 3: "executable" if interpreted else "library"}.get(kind, "unknown")
    needed, soname, names = [], 0, None
    if dynamic:
        step, word = (16, "Q") if wide else (8, "I")
        for k in range(min(dynamic[1] // step, MAX_DYNAMIC)):
            tag, value = b.get(dynamic[0] + k * step, word), b.get(dynamic[0] + k * step + step // 2, word)
            if tag == 0:
                break
            if tag == 1:
                needed.append(value)
            elif tag == 14:
                soname = value
            elif tag == 5:
                names = next((o + value - a for a, o, n in loads if a <= value < a + n), None)
    read = lambda v: b.text(names + v) if names is not None else ""
    return _result("ELF", ELF_MACHINES.get(machine, f"machine-{machine}"), name, [x for x in map(read, needed) if x], read(soname) if soname else "", _build_id(b, notes))


def _build_id(b: Bytes, notes: list[tuple[int, int]]) -> str:
    for offset, length in notes:
        at = offset
        while at + 12 <= offset + length:
            name, desc, kind = b.get(at, "I"), b.get(at + 4, "I"), b.get(at + 8, "I")
            start = at + 12 + (name + 3) // 4 * 4
            if kind == 3 and b.raw[at + 12 : at + 12 + name] == b"GNU\0" and 0 < desc <= 64:
                return b.raw[start : start + desc].hex()
            at = start + (desc + 3) // 4 * 4
    return ""


def pe(raw: bytes) -> dict:
    b = Bytes(raw)
    at = b.get(60, "I")
    if raw[at : at + 4] != b"PE\0\0":
        return _result("DOS", "x86", "executable")
    machine, sections, optional, flags = b.get(at + 4, "H"), b.get(at + 6, "H"), b.get(at + 20, "H"), b.get(at + 22, "H")
    head = at + 24
    directories = head + (112 if optional and b.get(head, "H") == 0x20B else 96)
    table = [tuple(b.get(head + optional + 40 * k + o, "I") for o in (8, 12, 16, 20)) for k in range(sections)]

    def offset(rva: int) -> int | None:
        return next((raw_at + rva - va for size, va, raw_size, raw_at in table if va <= rva < va + max(size, raw_size)), None)

    needed = []
    if optional:
        count = b.get(directories - 4, "I")
        for index, step, name_at in ((1, 20, 12), (13, 32, 4)):
            start = offset(b.get(directories + 8 * index, "I")) if count > index and b.get(directories + 8 * index, "I") else None
            while start is not None and len(needed) < MAX_NAMES and any(raw[start : start + step]):
                place = offset(b.get(start + name_at, "I"))
                if place is None:
                    break
                needed.append(b.text(place))
                start += step
    kind = "library" if flags & 0x2000 else "executable" if flags & 2 else "object"
    stated = {}
    if optional and b.get(directories - 4, "I") > 2 and b.get(directories + 16, "I"):
        try:
            stated = version_resource(_resource(b, offset, b.get(directories + 16, "I")))
        except (ValueError, struct.error):  # damaged resources state nothing
            stated = {}
    return _result("PE", PE_MACHINES.get(machine, f"machine-{machine}"), kind, needed, **stated)


def _resource(b: Bytes, offset: Callable[[int], int | None], rva: int) -> bytes:
    """The file's first version resource, empty without one: a tree of directories by type,
    name and language, whose leaf says where the data lies."""
    root = offset(rva)
    if root is None:
        return b""
    at = 0
    for level in range(3):
        count = b.get(root + at + 12, "H") + b.get(root + at + 14, "H")
        entries = [(b.get(root + at + 16 + 8 * k, "I"), b.get(root + at + 20 + 8 * k, "I")) for k in range(min(count, MAX_RESOURCES))]
        found = next((where for name, where in entries if level or name == VERSION_RESOURCE), None)
        if found is None:
            return b""
        at = found & 0x7FFFFFFF
        if not found >> 31:
            break
    place, size = offset(b.get(root + at, "I")), b.get(root + at + 4, "I")
    if place is None or size > MAX_VERSION_BYTES or place + size > len(b.raw):
        return b""
    return b.raw[place : place + size]


def _block(raw: bytes, at: int, end: int) -> tuple[str, bytes, int, int]:
    """Key, value, and where the children begin and end of a version block, which holds
    its length, its value's length (in words for texts), its kind, key, value, children;
    each part begins at a multiple of four."""
    size, length, kind = struct.unpack_from("<HHH", raw, at)
    stop, key = at + size, at + 6
    if size < 6 or stop > end:
        raise ValueError("a version block lies outside of its parent")
    while key + 2 <= stop and raw[key : key + 2] != b"\0\0":
        key += 2
    value = min((key + 2 + 3) // 4 * 4, stop)
    upto = min(value + length * (2 if kind == 1 else 1), stop)
    return raw[at + 6 : key].decode("utf-16-le", "replace"), raw[value:upto], min((upto + 3) // 4 * 4, stop), stop


def version_resource(raw: bytes) -> dict[str, str]:
    """The versions and names that a version resource states. Fixed versions of zeros are
    none; names come from the first table, by key and names, that has both."""
    if not raw:
        return {}
    budget = MAX_VERSION_BLOCKS

    def inner(at: int, end: int) -> Iterator[tuple[str, bytes, int, int]]:
        nonlocal budget
        while at + 6 <= end and budget > 0:
            budget -= 1
            try:
                block = _block(raw, at, end)
            except (ValueError, struct.error):
                return
            yield block
            at = (block[3] + 3) // 4 * 4

    key, fixed, at, end = _block(raw, 0, len(raw))
    if key.upper() != "VS_VERSION_INFO":
        return {}
    out = {}
    if len(fixed) >= 52 and struct.unpack_from("<I", fixed)[0] == FIXED_INFO:
        for name, where in (("file_version", 8), ("product_version", 16)):
            high, low = struct.unpack_from("<II", fixed, where)
            if high or low:
                out[name] = ".".join(str(n) for word in (high, low) for n in (word >> 16, word & 0xFFFF))
    found = []
    for group, _, start, stop in inner(at, end):
        if group.lower() != "stringfileinfo":
            continue
        for table, _, first, last in inner(start, stop):
            if not re.fullmatch("[0-9A-Fa-f]{8}", table):
                continue
            names: dict[str, list[str]] = {}
            for name, value, *_ in inner(first, last):
                text = value.decode("utf-16-le", "replace").partition("\0")[0].strip()
                if text:
                    names.setdefault(name.lower(), []).append(text)
            if "companyname" in names and "productname" in names:
                found.append((table.lower(), min(names["companyname"]), min(names["productname"])))
    if found:
        _, out["company_name"], out["product_name"] = min(found)
    return out


def mach(raw: bytes) -> dict:
    magic = struct.unpack_from(">I", raw)[0]
    if magic == 0xCAFEBABE:
        b = Bytes(raw, ">")
        parts = [mach(raw[(o := b.get(8 + 20 * k + 8, "I")) : o + b.get(8 + 20 * k + 12, "I")]) for k in range(min(b.get(4, "I"), 32))]
        if not parts:
            raise ValueError("no slices")
        return _result("Mach-O", ", ".join(p["architecture"] for p in parts), parts[0]["kind"], [n for p in parts for n in p["needed"]], parts[0]["soname"])
    b = Bytes(raw, "<" if magic in (0xCEFAEDFE, 0xCFFAEDFE) else ">")
    at = 32 if magic in (0xCFFAEDFE, 0xFEEDFACF) else 28
    needed, own = [], ""
    for _ in range(min(b.get(16, "I"), MAX_NAMES)):
        command, size = b.get(at, "I"), b.get(at + 4, "I")
        if size < 8:
            raise ValueError("a load command has no size")
        if command in DYLIB_COMMANDS:
            needed.append(b.text(at + b.get(at + 8, "I")))
        elif command == 0xD:
            own = b.text(at + b.get(at + 8, "I"))
        at += size
    return _result("Mach-O", MACH_CPUS.get(b.get(4, "I"), "unknown"), MACH_TYPES.get(b.get(12, "I"), "unknown"), needed, own)


def inspect(raw: bytes | None) -> dict | None:
    """None for what is no known binary; a diagnostic for a damaged one."""
    raw = raw or b""
    readers = (((b"\x7fELF",), elf, "ELF"), ((b"MZ",), pe, "PE"), ((b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe"), mach, "Mach-O"))
    if raw[:8] == b"!<arch>\n":
        return _result("ar", "", "static library")
    for magics, read, name in readers:
        if raw.startswith(magics):
            try:
                return read(raw)
            except (ValueError, struct.error, IndexError) as e:
                return _result(name, "", "unknown", diagnostic=str(e))
    return None


def _evidence(content: pd.Series) -> pd.DataFrame:
    empty = _result("", "", "")
    return pd.DataFrame([inspect(x) or empty for x in content], columns=list(empty))


def binary_evidence(content: Column | str) -> Column:
    """What inspect() says of each content; format is empty for what is no binary."""
    return F.pandas_udf(_evidence, BINARY)(content)


def _properties(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, eq, v in (x.partition("=") for x in text.splitlines() if not x.lstrip().startswith(("#", "!"))) if eq}


def coordinates(raw: bytes | None) -> list[dict]:
    """The coordinates inside a Java archive: one per pom.properties at its place, and the
    archive's own from its manifest. ValueError for damaged or oversized archives."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            infos = z.infolist()
            names = [i.filename for i in infos]
            if len(infos) > MAX_ENTRIES or len(set(names)) != len(names) or any(n.startswith("/") or ".." in n.split("/") for n in names):
                raise ValueError("the archive's entries are not safe")
            found = []
            wanted = [i for i in infos if re.fullmatch(r"META-INF/maven/[^/]+/[^/]+/pom\.properties", i.filename)]
            if len(wanted) > MAX_METADATA or any(i.file_size > MAX_METADATA_BYTES for i in wanted):
                raise ValueError("the archive's metadata is too large")
            for i in wanted:
                p = _properties(z.read(i).decode("utf-8", "replace"))
                group, artifact = i.filename.split("/")[2:4]
                if (p.get("groupId"), p.get("artifactId")) == (group, artifact):
                    found.append({"group_id": group, "artifact_id": artifact, "version": p.get("version", ""), "title": "", "path": i.filename})
            manifest = next((i for i in infos if i.filename == "META-INF/MANIFEST.MF" and i.file_size <= MAX_METADATA_BYTES), None)
            if manifest:
                text = re.sub(r"\r?\n ", "", z.read(manifest).decode("utf-8", "replace"))
                main = dict(x.partition(":")[::2] for x in re.split(r"\r?\n", text.split("\n\n")[0].split("\r\n\r\n")[0]))
                get = lambda *ks: next((main[k].strip() for k in ks if main.get(k, "").strip()), "")
                title, version = get("Implementation-Title", "Bundle-Name", "Bundle-SymbolicName"), get("Implementation-Version", "Bundle-Version")
                if title or version:
                    found.append({"group_id": "", "artifact_id": "", "version": version, "title": title, "path": manifest.filename})
            return found
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
        raise ValueError(str(e)) from e


def archive_coordinates(files: DataFrame) -> DataFrame:
    """relative_path, content -> relative_path, coordinates, diagnostic."""
    schema = f"relative_path string, coordinates {ARCHIVE}, diagnostic string"

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["relative_path"], pdf["content"], strict=True):
                try:
                    rows.append((path, coordinates(content), ""))
                except ValueError as e:
                    rows.append((path, [], str(e)))
            yield pd.DataFrame(rows, columns=["relative_path", "coordinates", "diagnostic"])

    return files.select("relative_path", "content").mapInPandas(run, schema)


def binary_components(files: DataFrame) -> DataFrame:
    """relative_path, content -> a header row per binary and a row per library it names.
    A version comes from the file's name, else from what a version resource states of the
    product, else of the file."""
    # not deterministic, as far as Spark is told: else it inspects anew for the filter
    inspected = F.pandas_udf(_evidence, BINARY).asNondeterministic()("content")
    found = files.select("relative_path", inspected.alias("b")).where("b.format <> ''")
    name = F.regexp_extract("relative_path", r"([^/]*)$", 1)
    none = F.lit("")
    base: list[Column] = [F.lit("native").alias("ecosystem"), F.col("relative_path").alias("source_artifact")]
    version = F.coalesce(*[F.nullif(c, none) for c in (native_library_version(name), F.col("b.product_version"), F.col("b.file_version"))], none)
    kind = F.col("b.kind")
    # a binary's row comes at place 0 of its libraries, so each is inspected once
    own = F.struct(
        name.alias("name"), version.alias("version"), F.when(kind == "executable", "application").when(kind.endswith("library"), "library").otherwise("file").alias("component_type"),
        *[F.col(f"b.{a}").alias(b) for a, b in (("soname", "native_soname"), ("build_id", "native_build_id"), ("company_name", "company_name"), ("product_name", "product_name"))],
    )
    each = found.select(*base, own.alias("own"), F.posexplode(F.concat(F.array(none), "b.needed")).alias("place", "library"))
    head = F.col("place") == 0
    library = F.regexp_extract("library", r"([^/\\]*)$", 1)
    pick = lambda f, other: F.when(head, F.col(f"own.{f}")).otherwise(other).alias(f)
    return each.where(head | (library != "")).select(
        pick("name", library), pick("version", native_library_version(library)), pick("component_type", F.lit("library")), "ecosystem", "source_artifact",
        F.when(head, "binary-header").otherwise("binary-dependency-table").alias("source_parser"), F.when(head, "").otherwise("runtime").alias("dependency_scope"),
        *[pick(f, none) for f in ("native_soname", "native_build_id", "company_name", "product_name")],
    )


def needed_from_text(text: Column) -> Column:
    """Library names in the text of an ELF reader's listing."""
    return F.regexp_extract_all(text, F.lit(r"\(NEEDED\)[^\[\n]*\[([^\]\n]+)\]"), F.lit(1))
