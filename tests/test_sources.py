import io
import os
import struct
import zipfile

from pyspark.sql import functions as F

from ledgerline import scan
from ledgerline.operators import classify
from ledgerline.sources import binaries, inventory
from ledgerline.streaming import history


def test_inventory(spark, tmp_path):
    inventory.register(spark)
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for p, t in {"x.txt": "1", ".hidden": "2", "_under": "3", "a/b/c/pom.xml": "<p/>", ".git/config": "no", "a/big": "x" * 100}.items():
        (tmp_path / p).write_text(t)
    os.symlink("/etc", tmp_path / "out")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    os.mkfifo(tmp_path / "pipe")
    read = lambda **o: {r["relative_path"]: r for r in spark.read.format("file_inventory").options(path=str(tmp_path), **o).load().collect()}
    rows = read(content="true", sha256="true", names="xml$")
    assert {p for p, r in rows.items() if r["entry_kind"] == "file"} == {"x.txt", ".hidden", "_under", "a/b/c/pom.xml", "a/big"}
    assert rows[".git"]["entry_kind"] == "ignored" and rows["pipe"]["entry_kind"] == "unsupported" and "out" not in rows
    assert bytes(rows["a/b/c/pom.xml"]["content"]) == b"<p/>" and rows["x.txt"]["content"] is None and rows["a/b/c/pom.xml"]["stable"]
    followed = read(followLinks="true")
    assert "leaves the root" in followed["out"]["message"] and followed["loop/b/c/pom.xml"]["file_size"] == 4
    (tmp_path / "z").mkdir()
    os.symlink(tmp_path, tmp_path / "z/up")
    whole = spark.read.format("file_inventory").options(path=str(tmp_path), followLinks="true").load()
    once = inventory.visited_once(whole)
    assert once.schema == whole.schema
    files = [r["relative_path"] for r in once.where("entry_kind = 'file'").collect()]
    assert sorted(files) == [".hidden", "_under", "a/b/c/pom.xml", "a/big", "x.txt"]
    warned = {r["relative_path"] for r in once.where("message = 'The folder was visited before.'").collect()}
    assert {"loop", "loop/b/c", "z/up"} <= warned


def elf(needed, soname):
    names = b"\0" + b"\0".join(n.encode() for n in [*needed, soname]) + b"\0"
    offsets, at = [], 1
    for n in [*needed, soname]:
        offsets.append(at)
        at += len(n) + 1
    head, phdr = 64, 56 * 3
    dyn_at = head + phdr
    entries = [(1, o) for o in offsets[:-1]] + [(14, offsets[-1])]
    str_at = dyn_at + 16 * (len(entries) + 2)
    note = struct.pack("<III", 4, 4, 3) + b"GNU\0" + b"\xde\xad\xbe\xef"
    note_at = str_at + len(names)
    dynamic = b"".join(struct.pack("<QQ", *e) for e in [*entries, (5, str_at), (0, 0)])
    total = note_at + len(note)
    program = lambda t, o, n: struct.pack("<IIQQQQQQ", t, 0, o, o, o, n, n, 0)
    ident = b"\x7fELF\x02\x01\x01" + b"\0" * 9
    header = ident + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 64, 0, 0, 64, 56, 3, 0, 0, 0)
    return header + program(1, 0, total) + program(2, dyn_at, len(dynamic)) + program(4, note_at, len(note)) + dynamic + names + note


def test_binaries(spark):
    raw = elf(["libc.so.6", "libz.so.1"], "libdemo.so.2")
    found = binaries.inspect(raw)
    assert found["kind"] == "library" and found["architecture"] == "x86_64" and found["needed"] == ["libc.so.6", "libz.so.1"]
    assert found["soname"] == "libdemo.so.2" and found["build_id"] == "deadbeef"
    assert binaries.inspect(raw[:100])["diagnostic"] and binaries.inspect(b"text") is None and binaries.inspect(b"!<arch>\n")["kind"] == "static library"
    dylib = lambda c, n: struct.pack("<IIIIII", c, 24 + 16, 24, 0, 0, 0) + n.ljust(16, b"\0")
    body = dylib(0xC, b"/usr/libz.dylib") + dylib(0xD, b"me.dylib")
    macho = struct.pack("<IIIIIIII", 0xFEEDFACF, 0x01000007, 0, 6, 2, len(body), 0, 0) + body
    assert binaries.inspect(macho)["needed"] == ["/usr/libz.dylib"] and binaries.inspect(macho)["soname"] == "me.dylib"
    files = spark.createDataFrame([("lib/libdemo.so", raw), ("x.txt", b"no"), ("m", macho)], "relative_path string, content binary")
    rows = [(r["name"], r["source_parser"], r["dependency_scope"]) for r in binaries.binary_components(files).collect()]
    assert sorted(rows) == [
        ("libc.so.6", "binary-dependency-table", "runtime"), ("libdemo.so", "binary-header", ""), ("libz.dylib", "binary-dependency-table", "runtime"),
        ("libz.so.1", "binary-dependency-table", "runtime"), ("m", "binary-header", ""),
    ]


def test_pe_imports():
    name, table = 0x300, 0x220
    raw = bytearray(0x400)
    raw[0:2], raw[60:64] = b"MZ", struct.pack("<I", 0x40)
    raw[0x40:0x58] = b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 240, 0x2022)
    raw[0x58:0x5A] = struct.pack("<H", 0x20B)
    raw[0x58 + 108 : 0x58 + 112] = struct.pack("<I", 16)
    raw[0x58 + 120 : 0x58 + 128] = struct.pack("<II", 0x1020, 40)
    raw[0x58 + 240 + 8 : 0x58 + 240 + 24] = struct.pack("<IIII", 0x200, 0x1000, 0x200, 0x200)
    raw[table : table + 20] = struct.pack("<IIIII", 0, 0, 0, 0x1100, 1)
    raw[name : name + 13] = b"KERNEL32.dll\0"
    found = binaries.inspect(bytes(raw))
    assert found["kind"] == "library" and found["needed"] == ["KERNEL32.dll"] and found["architecture"] == "x86_64"


def version_block(key, value=b"", children=b"", text=False):
    head = key.encode("utf-16-le") + b"\0\0"
    head += b"\0" * (-(6 + len(head)) % 4)
    body = value + (b"\0" * (-len(value) % 4) if children else b"") + children
    return struct.pack("<HHH", 6 + len(head) + len(body), len(value) // (2 if text else 1), int(text)) + head + body


def padded(*blocks):
    return b"".join(x + b"\0" * (-len(x) % 4) for x in blocks)


def version_info(versions=(0x10002, 0x30004, 0, 0), tables=(("040904b0", {"CompanyName": "Acme", "ProductName": "Rocket"}),)):
    texts = lambda names: padded(*[version_block(k, v.encode("utf-16-le") + b"\0\0", text=True) for k, v in names.items()])
    inside = padded(*[version_block(key, b"", texts(names)) for key, names in tables])
    fixed = struct.pack("<II4I", 0xFEEF04BD, 0x10000, *versions) + bytes(28)
    return version_block("VS_VERSION_INFO", fixed, padded(version_block("VarFileInfo"), version_block("StringFileInfo", b"", inside)))


def test_version_resources(spark):
    names = {"file_version": "1.2.3.4", "company_name": "Acme", "product_name": "Rocket"}
    assert binaries.version_resource(version_info()) == names
    several = (("040904b1", {"CompanyName": "A", "ProductName": "A"}), ("040904B0", {"CompanyName": "Z", "ProductName": "Y"}), ("040904a0", {"CompanyName": "half"}), ("nokey", {"CompanyName": "A", "ProductName": "B"}))
    assert binaries.version_resource(version_info((0, 0, 0x20000, 1), several)) == {"product_version": "2.0.0.1", "company_name": "Z", "product_name": "Y"}
    assert binaries.version_resource(b"") == {} and binaries.version_resource(version_block("OTHER", bytes(52))) == {}
    cut = version_info()
    for n in range(6, len(cut), 7):  # damaged children are left out
        assert set(binaries.version_resource(struct.pack("<H", n) + cut[2:n])) <= set(names)

    data = version_info()
    raw = bytearray(0x400) + bytearray(0x60) + data
    raw[0:2], raw[60:64] = b"MZ", struct.pack("<I", 0x40)
    raw[0x40:0x58] = b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 240, 0x22)
    raw[0x58:0x5A] = struct.pack("<H", 0x20B)
    raw[0x58 + 108 : 0x58 + 112] = struct.pack("<I", 16)
    raw[0x58 + 128 : 0x58 + 136] = struct.pack("<II", 0x1000, 0x60 + len(data))
    raw[0x58 + 240 + 8 : 0x58 + 240 + 24] = struct.pack("<IIII", 0x1000, 0x1000, 0x1000, 0x400)
    level = lambda name, where: struct.pack("<IIHHHHII", 0, 0, 0, 0, 0, 1, name, where)
    tree = level(16, 1 << 31 | 24) + level(1, 1 << 31 | 48) + level(1033, 72) + struct.pack("<IIII", 0x1060, len(data), 0, 0)
    raw[0x400 : 0x400 + len(tree)] = tree
    files = spark.createDataFrame([("bin/rocket.exe", bytes(raw)), ("bin/plain.exe", bytes(raw[:0x400]))], "relative_path string, content binary")
    rows = {r["name"]: r for r in binaries.binary_components(files).collect()}
    assert (rows["rocket.exe"]["version"], rows["rocket.exe"]["company_name"], rows["rocket.exe"]["component_type"]) == ("1.2.3.4", "Acme", "application")
    assert (rows["plain.exe"]["version"], rows["plain.exe"]["company_name"]) == ("", "")
    made = scan._from_binaries(files.withColumn("sha256", F.sha2("content", 256))).where("name = 'rocket.exe'").first()
    assert made["cpe"] == "cpe:2.3:a:acme:rocket:1.2.3.4:*:*:*:*:*:*:*" and made["package_url"].startswith("pkg:generic/rocket.exe@1.2.3.4?checksum=sha256:")


def test_archives(spark):
    def jar(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in entries:
                z.writestr(n, t)
        return out.getvalue()

    good = jar([("META-INF/maven/g/a/pom.properties", "groupId=g\nartifactId=a\nversion=1.0"), ("META-INF/MANIFEST.MF", "Manifest-Version: 1\r\nImplementation-Title: Demo\r\nImplementation-Version: 2\r\n\r\nName: x")])
    bad = jar([("META-INF/maven/g/a/pom.properties", "groupId=other\nartifactId=a\nversion=1.0")])
    files = spark.createDataFrame([("g.jar", good), ("b.jar", bad), ("n.jar", b"no zip"), ("e.jar", jar([("../x", "")]))], "relative_path string, content binary")
    rows = {r["relative_path"]: r for r in binaries.archive_coordinates(files).collect()}
    assert [(c["group_id"], c["artifact_id"], c["version"], c["title"]) for c in rows["g.jar"]["coordinates"]] == [("g", "a", "1.0", ""), ("", "", "2", "Demo")]
    assert rows["b.jar"]["coordinates"] == [] and rows["n.jar"]["diagnostic"] and rows["e.jar"]["diagnostic"]


def test_classifier(spark):
    paths = {"a/Cargo.TOML": "conservative-cargo-toml", "node_modules/x/package.json": "installed-package-json", "x-1.dist-info/METADATA": "python-dist-info-metadata", ".dist-info/METADATA": None, "Requirements-x.txt": "requirements-text", "main.c": None}
    df = classify.classify(spark.createDataFrame([(p, 1) for p in paths], "relative_path string, file_size long"))
    assert {r["relative_path"]: r["parser"] for r in df.collect()} == paths


def walked(spark, root, **options):
    rows = inventory.walk(spark, {"path": str(root), **options}).collect()
    return sorted((r["relative_path"], r["entry_kind"], r["message"]) for r in rows)


def test_walk_lists_what_the_data_source_lists(spark, tmp_path):
    inventory.register(spark)
    for at in ("a/b/c/d/e", "a/.git/x", "f", "g/h"):
        os.makedirs(tmp_path / at)
        (tmp_path / at / "file.txt").write_text(at)
    (tmp_path / "top.txt").write_text("x")
    os.mkfifo(tmp_path / "a/pipe")
    os.symlink(tmp_path / "top.txt", tmp_path / "f/link")
    for options in ({}, {"followLinks": "true"}, {"content": "true", "sha256": "true"}):
        source = spark.read.format("file_inventory").options(path=str(tmp_path), **options).load()
        names = [c for c in source.columns if c != "folder"]
        of = lambda df, names=names: sorted(tuple(map(str, r)) for r in df.select(names).collect())
        assert of(source) == of(inventory.walk(spark, {"path": str(tmp_path), **options}))


def test_walk_of_a_deep_a_flat_and_a_cyclic_tree(spark, tmp_path):
    deep = tmp_path / "deep"
    os.makedirs(deep / "/".join(["d"] * 25))
    (deep / "/".join(["d"] * 25) / "end").write_text("x")
    assert walked(spark, deep) == [("/".join(["d"] * 25) + "/end", "file", "")]
    flat = tmp_path / "flat"
    for k in range(60):
        os.makedirs(flat / f"n{k}")
        (flat / f"n{k}" / "file").write_text("x")
    rows = inventory.walk(spark, {"path": str(flat)})
    assert rows.count() == 60 and sum(1 for p in rows.rdd.glom().collect() if p) >= 4  # many tasks wrote them
    ring = tmp_path / "ring"
    os.makedirs(ring / "a/b")
    os.makedirs(ring / "z")
    (ring / "a/b/file").write_text("x")
    os.symlink(ring, ring / "a/b/up")
    os.symlink(ring / "a", ring / "z/again")
    os.symlink(ring / "a/b", ring / "shallow")
    os.symlink(tmp_path / "flat", ring / "outside")
    visited = "The folder was visited before."
    assert walked(spark, ring, followLinks="true") == [
        ("a/b", "warning", visited), ("outside", "warning", "The link leaves the root."), ("shallow/file", "file", ""), ("shallow/up", "warning", visited), ("z/again", "warning", visited),
    ]
    everything = walked(spark, ring, followLinks="true", allowOutsideRoot="true")
    assert [p for p, k, _ in everything if k == "file"] == sorted(["shallow/file", *[f"outside/n{k}/file" for k in range(60)]])


def test_history_and_stream(spark, tmp_path):
    folder = str(tmp_path / "history")
    row = lambda i, s, day: (i, f"2024-01-0{day}T10:00:00.000Z", "", "", "", "root", s, 3, 10, 1, 0, 0)
    history.append(spark.createDataFrame([row("a-1", "completed", 1), row("a-2", "running", 1), row("a-3", "odd", 2)], history.TASK), folder)
    got = {r["id"]: r for r in history.load(spark, folder).collect()}
    assert got["a-1"]["status"] == "completed" and got["a-2"]["status"] == got["a-3"]["status"] == "failed" and got["a-2"]["errors"] == 1
    history.delete(spark, folder, "a-1", str(tmp_path / "next"))
    assert {r["id"] for r in spark.read.schema(history.TASK).json(str(tmp_path / "next")).collect()} == {"a-2", "a-3"}
    query = history.daily_totals(history.follow(spark, folder)).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["scans"] for r in spark.table("totals").collect()) == [1, 2]
