"""Registered queries of binaries and archives: images and archives are made from whole
tables, a file per row or order, some of them damaged, and read back as a scan reads them."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import spread
from ..sources import binaries

FILES = "relative_path string, content binary"
#: Numbers of ELF and PE that the images state, by their order.
MACHINES = (62, 183, 3, 40)
BASE = 0x10000


def elf_image(number: int, needed: list[str], soname: str, build_id: bytes, kind: int, interpreted: bool) -> bytes:
    """An ELF image of either width and byte order, by its number; its names lie at
    addresses apart from their offsets."""
    wide, order = number % 2 == 0, "<" if number // 2 % 2 == 0 else ">"
    names, at = b"\0", {}
    for n in [*needed, soname]:
        at[n] = len(names)
        names += n.encode() + b"\0"
    word = "Q" if wide else "I"
    head, entry = (64, 56) if wide else (52, 32)
    tags = [(1, at[n]) for n in needed] + ([(14, at[soname])] if soname else [])
    count = 3 + interpreted
    start = head + entry * count
    size = struct.calcsize("<" + word) * 2
    names_at = start + size * (len(tags) + 2)
    note = struct.pack(order + "III", 4, len(build_id), 3) + b"GNU\0" + build_id
    dynamic = b"".join(struct.pack(order + 2 * word, *t) for t in [*tags, (5, BASE + names_at), (0, 0)])
    note_at = names_at + len(names)

    def program(t: int, offset: int, length: int) -> bytes:
        if wide:
            return struct.pack(order + "IIQQQQQQ", t, 4, offset, BASE + offset, BASE + offset, length, length, 8)
        return struct.pack(order + "IIIIIIII", t, offset, BASE + offset, BASE + offset, length, length, 4, 4)

    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2, 1]) + bytes(9)
    fields = (kind, MACHINES[number % 4], 1, 0, head, 0, 0, head, entry, count, 0, 0, 0)
    header = ident + struct.pack(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), *fields)
    programs = program(1, 0, note_at + len(note)) + program(2, start, len(dynamic)) + program(4, note_at, len(note)) + (program(3, 0, 1) if interpreted else b"")
    return header + programs + dynamic + names + note


def _block(key: str, value: bytes = b"", children: bytes = b"", text: bool = False) -> bytes:
    head = key.encode("utf-16-le") + b"\0\0"
    head += bytes(-(6 + len(head)) % 4)
    body = value + bytes(-len(value) % 4 if children else 0) + children
    return struct.pack("<HHH", 6 + len(head) + len(body), len(value) // (2 if text else 1), int(text)) + head + body


def _padded(*blocks: bytes) -> bytes:
    return b"".join(x + bytes(-len(x) % 4) for x in blocks)


def pe_image(wide: bool, library: bool, imports: list[str], version: tuple[int, int, int, int], company: str, product: str) -> bytes:
    """A PE image with an import table and a version resource in one section."""
    names = _padded(*[_block(k, v.encode("utf-16-le") + b"\0\0", text=True) for k, v in (("CompanyName", company), ("ProductName", product))])
    fixed = struct.pack("<II4I", 0xFEEF04BD, 0x10000, version[0] << 16 | version[1], version[2] << 16 | version[3], 0, 0) + bytes(28)
    stated = _block("VS_VERSION_INFO", fixed, _padded(_block("StringFileInfo", b"", _block("040904b0", b"", names))))
    section, va, raw_at = bytearray(), 0x1000, 0x400
    table_size = 20 * (len(imports) + 1)
    section += bytes(table_size)
    for k, name in enumerate(imports):
        struct.pack_into("<IIIII", section, 20 * k, 0, 0, 0, va + len(section), 1)
        section += name.encode() + b"\0"
    section += bytes(-len(section) % 4)
    tree = len(section)
    level = lambda name, where: struct.pack("<IIHHHHII", 0, 0, 0, 0, 0, 1, name, where)
    section += level(16, 1 << 31 | 24) + level(1, 1 << 31 | 48) + level(1033, 72) + struct.pack("<IIII", va + tree + 88, len(stated), 0, 0) + stated
    raw = bytearray(raw_at)
    raw[0:2], raw[60:64] = b"MZ", struct.pack("<I", 0x40)
    optional, gap = (240, 112) if wide else (224, 96)
    raw[0x40:0x58] = b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664 if wide else 0x14C, 1, 0, 0, 0, optional, 0x2022 if library else 0x22)
    struct.pack_into("<H", raw, 0x58, 0x20B if wide else 0x10B)
    struct.pack_into("<I", raw, 0x58 + gap - 4, 16)
    struct.pack_into("<II", raw, 0x58 + gap + 8, va, table_size)
    struct.pack_into("<II", raw, 0x58 + gap + 16, va + tree, 88 + len(stated))
    struct.pack_into("<IIII", raw, 0x58 + optional + 8, len(section), va, len(section), raw_at)
    return bytes(raw + section)


def mach_image(order: str, needed: list[str], own: str) -> bytes:
    def command(kind: int, name: str) -> bytes:
        text = name.encode() + b"\0"
        text += bytes(-len(text) % 8)
        return struct.pack(order + "IIIIII", kind, 24 + len(text), 24, 0, 0, 0) + text

    body = b"".join(command(0xC, n) for n in needed) + command(0xD, own)
    return struct.pack(order + "IIIIIIII", 0xFEEDFACF, 0x01000007, 0, 6, len(needed) + 1, len(body), 0, 0) + body


def _made(rows: DataFrame, one) -> DataFrame:
    """Files of rows: one(row) gives (relative_path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(r) for r in part.itertuples()], columns=["relative_path", "content"])

    return rows.mapInPandas(run, FILES)


def _elf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    library = F.concat(F.lit("lib"), "l_partkey", F.lit(".so."), "l_linenumber", F.lit("."), "l_suppkey")
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", library.alias("name")))).getField("name").alias("needed"))

    def one(r) -> tuple[str, bytes]:
        k = r.l_orderkey
        path = f"lib/libo{k}.so.1.{k % 7}" if k % 3 == 0 else f"bin/tool-{k}"
        soname = f"libo{k}.so.1" if k % 3 == 0 else ""
        raw = elf_image(k % 4, list(r.needed), soname, k.to_bytes(8, "big"), 3 if k % 5 else 2, k % 3 == 1)
        return path, raw[:40] if k % 17 == 0 else raw

    return _made(rows, one)


def _pe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size"))

    def one(r) -> tuple[str, bytes]:
        k = r.p_partkey
        raw = pe_image(k % 2 == 0, k % 3 == 0, [f"P{k}.dll", f"dir{r.p_size}.DLL"][: k % 4 and 2], (r.p_size, k % 60000, 0, 1), r.p_brand, r.p_name)
        return f"win/p{k}.exe", raw[:70] if k % 13 == 0 else raw

    return _made(part, one)


def _mach_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey"))

    def one(r) -> tuple[str, bytes]:
        return f"mac/s{r.s_suppkey}", mach_image("<" if r.s_suppkey % 2 else ">", [f"/usr/lib/n{r.s_nationkey}.1.2.dylib"], f"@rpath/s{r.s_suppkey}.dylib")

    return _made(rows, one)


def binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ELF images of the orders, PE images of the parts and Mach-O images of
    the suppliers; damaged images among them."""
    files = _elf_files(spark, sf_dir).unionByName(_pe_files(spark, sf_dir)).unionByName(_mach_files(spark, sf_dir))
    found = binaries.binary_components(files)
    return found.select("source_artifact", "source_parser", "name", "version", "component_type", "dependency_scope", "native_soname", "native_build_id", "company_name", "product_name")


def binary_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, architecture and kind of the same images, and whether they are damaged; text
    and archives of object files beside them."""
    files = _elf_files(spark, sf_dir).unionByName(_pe_files(spark, sf_dir)).unionByName(_mach_files(spark, sf_dir))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    other = pages.select(F.concat(F.lit("page/"), "page_id").alias("relative_path"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("!<arch>\n"), "html")).otherwise(F.col("html")).cast("binary").alias("content"))
    found = files.unionByName(other).select("relative_path", binaries.binary_evidence("content").alias("b"))
    return found.select("relative_path", "b.format", "b.architecture", "b.kind", (F.col("b.diagnostic") != "").alias("damaged"), F.size("b.needed").alias("n_needed"))


def listed_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries in listings of an ELF reader, one per order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    tag = F.when(F.col("l_returnflag") == "A", "RPATH").otherwise("NEEDED")
    line = F.concat(F.lit(" 0x01 ("), tag, F.lit(")   Shared library: [lib"), "l_partkey", F.lit(".so."), "l_linenumber", F.lit("]"))
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return texts.select("l_orderkey", F.explode(binaries.needed_from_text(F.col("text"))).alias("library"))


def _jar(entries: list[tuple[str, str]], stored: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, text in entries:
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size"))

    def from_part(r) -> tuple[str, bytes]:
        k, group, artifact = r.p_partkey, f"org.b{r.p_size}", r.p_name.replace(" ", "-")
        path = f"META-INF/maven/{group}/{artifact}/pom.properties"
        text = f"# made\ngroupId={'other' if k % 8 == 2 else group}\nartifactId = {artifact}\nversion=1.{k}\n"
        entries = [(path, text), ("data.txt", r.p_name)]
        if k % 8 == 1:
            entries.append(("META-INF/MANIFEST.MF", f"Manifest-Version: 1.0\r\nImplementation-Title: {r.p_name}\r\nImplementation-Version: {r.p_size}\r\n\r\nName: x\r\nBundle-Name: no\r\n"))
        if k % 8 == 5:
            entries.append(("../escape", "x"))
        raw = _jar(entries, stored=True)
        if k % 8 == 3:  # without its directory
            raw = raw[: len(raw) // 2]
        elif k % 8 == 4:  # a byte that its checksum doesn't know
            raw = raw.replace(b"# made", b"# mode", 1)
        elif k % 8 == 6:  # a local header of another name
            raw = raw.replace(path.encode(), b"X" + path.encode()[1:], 1)
        return f"jar/{k}.jar", raw

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")

    def from_page(r) -> tuple[str, bytes]:
        url = r.url or ""
        folded = "\r\n ".join(url[i : i + 20] for i in range(0, len(url), 20))
        return f"war/{r.page_id}.war", _jar([("index.html", r.html or ""), ("META-INF/MANIFEST.MF", f"Bundle-Name: {folded}\r\nBundle-Version: {r.page_id}\r\n")])

    return _made(part, from_part).unionByName(_made(pages, from_page))


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates in archives of the parts and pages, whole and damaged."""
    found = binaries.archive_coordinates(_archives(spark, sf_dir))
    each = found.select("relative_path", (F.col("diagnostic") != "").alias("failed"), F.explode_outer("coordinates").alias("c"))
    return each.select("relative_path", "failed", "c.group_id", "c.artifact_id", "c.version", "c.title")


QUERIES = {f.__name__: f for f in (binary_rows, binary_headers, listed_libraries, archive_rows)}

_ELF = """o AS (SELECT DISTINCT l_orderkey AS k, l_orderkey % 17 = 0 AS bad FROM lineitem),
e AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'lib/libo' || k || '.so.1.' || (k % 7) ELSE 'bin/tool-' || k END AS path,
  CASE WHEN bad THEN 'unknown' WHEN k % 5 = 0 THEN 'executable' WHEN k % 3 = 1 THEN 'executable' ELSE 'library' END AS kind FROM o)"""
_NO = "'' AS native_soname, '' AS native_build_id, '' AS company_name, '' AS product_name"
ORACLES = {
    "binary_rows": f"""WITH {_ELF}, p AS (SELECT p_partkey AS k, p_partkey % 13 = 0 AS bad, * FROM part)
SELECT path AS source_artifact, 'binary-header' AS source_parser, split_part(path, '/', 2) AS name, CASE WHEN k % 3 = 0 THEN '1.' || (k % 7) ELSE '' END AS version,
  CASE kind WHEN 'executable' THEN 'application' WHEN 'library' THEN 'library' ELSE 'file' END AS component_type, '' AS dependency_scope,
  CASE WHEN k % 3 = 0 AND NOT bad THEN 'libo' || k || '.so.1' ELSE '' END AS native_soname, CASE WHEN bad THEN '' ELSE lower(lpad(hex(k), 16, '0')) END AS native_build_id, '' AS company_name, '' AS product_name FROM e
UNION ALL SELECT path, 'binary-dependency-table', 'lib' || l_partkey || '.so.' || l_linenumber || '.' || l_suppkey, l_linenumber || '.' || l_suppkey, 'library', 'runtime', {_NO} FROM e JOIN lineitem ON k = l_orderkey WHERE NOT bad
UNION ALL SELECT 'win/p' || k || '.exe', 'binary-header', 'p' || k || '.exe', CASE WHEN bad THEN '' ELSE p_size || '.' || (k % 60000) || '.0.1' END, CASE WHEN bad THEN 'file' WHEN k % 3 = 0 THEN 'library' ELSE 'application' END,
  '', '', '', CASE WHEN bad THEN '' ELSE p_brand END, CASE WHEN bad THEN '' ELSE p_name END FROM p
UNION ALL SELECT 'win/p' || k || '.exe', 'binary-dependency-table', unnest(['P' || k || '.dll', 'dir' || p_size || '.DLL']), '', 'library', 'runtime', {_NO} FROM p WHERE NOT bad AND k % 4 <> 0
UNION ALL SELECT 'mac/s' || s_suppkey, 'binary-header', 's' || s_suppkey, '', 'library', '', '@rpath/s' || s_suppkey || '.dylib', '', '', '' FROM supplier
UNION ALL SELECT 'mac/s' || s_suppkey, 'binary-dependency-table', 'n' || s_nationkey || '.1.2.dylib', '1.2', 'library', 'runtime', {_NO} FROM supplier""",
    "binary_headers": f"""WITH {_ELF}, n AS (SELECT l_orderkey AS k, count(DISTINCT 'lib' || l_partkey || '.so.' || l_linenumber || '.' || l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT path AS relative_path, 'ELF' AS format, CASE WHEN bad THEN '' ELSE ['x86_64', 'arm64', 'x86', 'arm'][k % 4 + 1] END AS architecture, kind, bad AS damaged, CAST(CASE WHEN bad THEN 0 ELSE n END AS INTEGER) AS n_needed FROM e JOIN n USING (k)
UNION ALL SELECT 'win/p' || p_partkey || '.exe', 'PE', CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'x86_64' ELSE 'x86' END,
  CASE WHEN p_partkey % 13 = 0 THEN 'unknown' WHEN p_partkey % 3 = 0 THEN 'library' ELSE 'executable' END, p_partkey % 13 = 0, CASE WHEN p_partkey % 13 = 0 OR p_partkey % 4 = 0 THEN 0 ELSE 2 END FROM part
UNION ALL SELECT 'mac/s' || s_suppkey, 'Mach-O', 'x86_64', 'library', false, 1 FROM supplier
UNION ALL SELECT 'page/' || page_id, CASE WHEN page_id % 2 = 0 AND html IS NOT NULL THEN 'ar' ELSE '' END, '', CASE WHEN page_id % 2 = 0 AND html IS NOT NULL THEN 'static library' ELSE '' END, false, 0 FROM pages""",
    "listed_libraries": "SELECT l_orderkey, 'lib' || l_partkey || '.so.' || l_linenumber AS library FROM lineitem WHERE l_returnflag <> 'A'",
    "archive_rows": """WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS m, 'jar/' || p_partkey || '.jar' AS path, p_name, p_size FROM part)
SELECT path AS relative_path, false AS failed, 'org.b' || p_size AS group_id, replace(p_name, ' ', '-') AS artifact_id, '1.' || k AS version, '' AS title FROM p WHERE m IN (0, 1, 7)
UNION ALL SELECT path, false, '', '', CAST(p_size AS VARCHAR), p_name FROM p WHERE m = 1 UNION ALL SELECT path, m <> 2, NULL, NULL, NULL, NULL FROM p WHERE m IN (2, 3, 4, 5, 6)
UNION ALL SELECT 'war/' || page_id || '.war', false, '', '', CAST(page_id AS VARCHAR), coalesce(url, '') FROM pages""",
}
