import io
import json
import zipfile

from ledgerline import scan as scanning
from ledgerline.__main__ import main
from ledgerline.scan import scan
from ledgerline.settings import Settings

from .test_sources import elf


def jar(*coordinates):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for g, a, v in coordinates:
            z.writestr(f"META-INF/maven/{g}/{a}/pom.properties", f"groupId={g}\nartifactId={a}\nversion={v}")
    return out.getvalue()


def tree(folder):
    files = {
        "web/package.json": b'{"name": "app", "version": "1.0.0", "dependencies": {"left": "1.2.3"}}',
        "web/package-lock.json": b'{"lockfileVersion": 3, "packages": {"": {"name": "app", "version": "1.0.0"}, "node_modules/left": {"version": "1.2.3"}}}',
        "py/requirements.txt": b"requests==2.31.0\n", "bad/package.json": b"{oops", "Gemfile": b"gem 'x'", "LICENSE": b"text",
        "lib/libdemo.so": elf(["libz.so.1"], "libdemo.so.2"), "lib/one.jar": jar(("g", "a", "1.0")), "lib/two.jar": jar(("g", "a", "1.0"), ("h", "b", "2.0")),
        "lib/no.jar": b"no zip", "lib/x.a": b"!<arch>\nrest", "lib/fake.a": b"text", "main.c": b"int main;", "node_modules/x/package.json": b"{}",
    }
    for path, content in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_bytes(content)


def test_scan_of_a_tree(spark, tmp_path):
    tree(tmp_path)
    found = scan(spark, str(tmp_path))
    artifacts = {r["relative_path"]: r for r in found.artifacts.collect()}
    assert {p: (r["status"], r["component_count"]) for p, r in artifacts.items()} == {
        "web/package.json": ("parsed", 2), "web/package-lock.json": ("parsed", 2), "py/requirements.txt": ("parsed", 1), "bad/package.json": ("failed", 0),
        "Gemfile": ("detected but unsupported", 0), "LICENSE": ("detected but unsupported", 0), "lib/libdemo.so": ("parsed", 2), "lib/one.jar": ("parsed", 1),
        "lib/two.jar": ("parsed", 3), "lib/no.jar": ("failed", 0), "lib/x.a": ("parsed", 1),
    }
    assert artifacts["LICENSE"]["sha256"] == "" and len(artifacts["Gemfile"]["sha256"]) == 64 and artifacts["lib/x.a"]["absolute_path"] == ""
    components = {(r["name"], r["version"], r["component_type"]): r for r in found.components.collect()}
    left = components["left", "1.2.3", "library"]
    assert left["package_url"] == "pkg:npm/left@1.2.3" and left["evidence_paths"] == ["web/package-lock.json", "web/package.json"]
    assert {k[0] for k in components} == {"app", "left", "requests", "libdemo.so", "libz.so.1", "g:a", "h:b", "two", "x.a"}
    assert found.warnings.count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    tree(tmp_path / "in")
    output = tmp_path / "out.json"
    assert main(["--scan", str(tmp_path / "in"), "--output", str(output)], spark) == 0
    document = json.loads(output.read_text())
    assert document["specVersion"] == "1.7" and document["metadata"]["component"]["name"] == "in"
    names = {c["name"] for c in document["components"]}
    assert {"left", "requests", "libdemo.so"} <= names and "parsed: 7" in capsys.readouterr().out
    library = next(c for c in document["components"] if c["name"] == "libz.so.1")
    binary = next(c for c in document["components"] if c["name"] == "libdemo.so")
    assert library["bom-ref"] in next(d["dependsOn"] for d in document["dependencies"] if d["ref"] == binary["bom-ref"])
    assert main(["--scan", str(tmp_path), "--output", str(output), "--refresh"], spark) == 2
    assert main(["--scan", str(tmp_path / "missing"), "--output", str(output)], spark) == 2
    (tmp_path / "s.json").write_text("[]")
    assert main(["--scan", str(tmp_path), "--output", str(output), "--settings", str(tmp_path / "s.json")], spark) == 2
    assert main(["--scan", str(tmp_path / "in"), "--output", str(tmp_path / "no" / "out.json")], spark) == 1


def test_empty_tree(spark, tmp_path):
    found = scan(spark, str(tmp_path), Settings(calculate_sha256=False))
    assert found.artifacts.count() == found.components.count() == 0


def test_unchanged_files_are_not_parsed_again(spark, tmp_path, monkeypatch):
    root, kept = tmp_path / "in", f"file://{tmp_path}/cache"
    root.mkdir()
    tree(root)
    rows = lambda found: [sorted(map(str, df.collect())) for df in (found.artifacts, found.components)]
    plain = rows(scan(spark, str(root)))
    assert rows(scan(spark, str(root), Settings(), kept)) == plain
    parsed = []
    own = scanning.parse.components
    monkeypatch.setattr(scanning.parse, "components", lambda texts, ps: parsed.append(sorted(r[0] for r in texts.select("relative_path").collect())) or own(texts, ps))
    monkeypatch.setattr(scanning.binaries, "archive_coordinates", lambda files: 1 / 0)
    assert rows(scan(spark, str(root), Settings(), kept)) == plain and parsed == []
    (root / "py/requirements.txt").write_bytes(b"requests==2.32.0\n")
    found = scan(spark, str(root), Settings(), kept)
    assert parsed == [["py/requirements.txt"]] and found.components.where("version = '2.32.0'").count() == 1
    assert [r["name"] for r in found.components.where("name = 'left'").collect()] == ["left"]
    # refresh parses everything, and so does a scan with other settings
    for settings in (Settings(refresh_rescan_cache=True), Settings(calculate_sha256=False)):
        try:
            scan(spark, str(root), settings, kept)
            raise AssertionError("an archive was not read")
        except ZeroDivisionError:
            pass
