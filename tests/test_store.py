"""Versions of a table under writers that collide, die or leave damage, and the history's
events, replayed and streamed."""

import glob
import os
import shutil

import pytest

from ledgerline.operators import cache
from ledgerline.sources import store
from ledgerline.streaming import history


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(found):
    return None if found[0] is None else sorted(r["v"] for r in found[0].collect())


def test_versions_follow_each_other(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert store.load(spark, folder) == (None, 0, 0)
    assert store.commit(rows(spark, 1), folder, 0) == 1 and store.commit(rows(spark, 2, 3), folder, 1) == 2
    assert held(store.load(spark, folder)) == [2, 3] and store.load(spark, folder)[1:] == (2, 2)
    with pytest.raises(store.Conflict):
        store.commit(rows(spark, 9), folder, 1)
    assert held(store.load(spark, folder)) == [2, 3]
    assert store.update(spark, folder, lambda t: t.unionByName(rows(spark, 4))) == 3
    assert held(store.load(spark, folder)) == [2, 3, 4]
    assert store.commit(rows(spark).limit(0), folder, 3) == 4 and held(store.load(spark, folder)) == []


def test_a_writer_that_is_second_builds_on_the_first(spark, tmp_path, monkeypatch):
    folder, real, late = str(tmp_path / "t"), store._create_once, []

    def slow(s, f, version, text):
        if not late:
            late.append(1)
            real(s, f, version, text.replace("data-", "data-")) if False else store.commit(rows(spark, 7), folder, 0)
        real(s, f, version, text)

    monkeypatch.setattr(store, "_create_once", lambda *a: slow(*a))
    store.update(spark, folder, lambda t: rows(spark, 1) if t is None else t.unionByName(rows(spark, 1)))
    assert held(store.load(spark, folder)) == [1, 7]


@pytest.mark.parametrize("damage", ["dies before naming", "empty name", "half a name", "rows gone", "rows unfinished", "fewer rows", "name elsewhere"])
def test_the_version_before_counts_after_damage(spark, tmp_path, monkeypatch, damage):
    folder = str(tmp_path / "t")
    store.commit(rows(spark, 1), folder, 0)
    if damage == "dies before naming":
        monkeypatch.setattr(store, "_create_once", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.commit(rows(spark, 2), folder, 1)
        monkeypatch.undo()
        assert held(store.load(spark, folder)) == [1] and store.commit(rows(spark, 3), folder, 1) == 2
        return
    store.commit(rows(spark, 2, 3, 4), folder, 1)
    name = f"{folder}/v000000000002.json"
    data = f"{folder}/" + open(name).read().split('"data": "')[1].split('"')[0]
    if damage in ("empty name", "half a name", "name elsewhere"):
        text = open(name).read()
        for crc in glob.glob(f"{folder}/.v*.crc"):
            os.remove(crc)
        open(name, "w").write({"empty name": "", "half a name": text[: len(text) // 2], "name elsewhere": text.replace("data-", "../data-")}[damage])
    elif damage == "rows gone":
        shutil.rmtree(data)
    elif damage == "rows unfinished":
        os.remove(f"{data}/_SUCCESS")
    else:
        os.remove(max(glob.glob(f"{data}/part-*.parquet"), key=os.path.getsize))
    found = store.load(spark, folder)
    assert held(found) == [1] and found[1:] == (1, 2)
    assert store.commit(rows(spark, 5), folder, found[2]) == 3 and held(store.load(spark, folder)) == [5]


def test_vacuum_keeps_the_newest(spark, tmp_path):
    folder = str(tmp_path / "t")
    for n in range(4):
        store.commit(rows(spark, n), folder, n)
    rows(spark, 9).write.parquet(f"{folder}/data-{'0' * 32}")
    assert store.vacuum(spark, folder, keep=2) == 3
    assert store.versions(spark, folder) == [4, 3] and held(store.load(spark, folder)) == [3]


def test_snapshots_of_two_contexts(spark, tmp_path):
    folder = str(tmp_path / "c")
    entry = lambda p, e: spark.createDataFrame([(p, "1", "d", e)], "relative_path string, identity string, content_sha256 string, evidence string")
    cache.commit(spark, entry("a", "x"), folder, "one")
    cache.commit(spark, entry("b", "y"), folder, "two")
    cache.commit(spark, entry("c", "z"), folder, "one")
    assert sorted((r["relative_path"], r["context"]) for r in cache.load(spark, folder).collect()) == [("b", "two"), ("c", "one")]
    with pytest.raises(ValueError):
        cache.commit(spark, entry("", "x"), folder, "one")
    with pytest.raises(ValueError):
        cache.commit(spark, entry("a", "x").unionByName(entry("a", "y")), folder, "one")
    assert cache.load(spark, folder).count() == 2


def task(spark, *rows):
    names = [f.split(" ")[0] for f in history.TASK.split(", ")]
    return spark.createDataFrame([tuple({"id": i, "status": s}.get(n) for n in names) for i, s in rows], history.TASK)


def test_history_falls_back_on_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "h")
    history.save(task(spark, ("a", "completed"), ("b", "running")), folder, 0)
    with pytest.raises(ValueError):
        history.save(task(spark, ("a", "completed"), ("a", "failed")), folder, 1)
    store.commit(task(spark, ("Not Safe", "completed")), folder, 1)
    store.commit(task(spark, ("c", "completed")), folder, 2)
    os.remove(glob.glob(f"{folder}/.v000000000003.json.crc")[0]) if glob.glob(f"{folder}/.v000000000003.json.crc") else None
    open(f"{folder}/v000000000003.json", "w").close()
    found, taken, warning = history.reopen(spark, folder)
    assert {r["id"]: r["status"] for r in found.collect()} == {"a": "completed", "b": "failed"}
    assert taken == 3 and "3" in warning and "1" in warning
    history.save(task(spark, ("d", "completed")), folder, taken)
    assert history.reopen(spark, folder)[1:] == (4, "")


LOG = [("a", 1, "running", False), ("a", 2, "running", False), ("b", 3, "running", None), ("a", 4, "completed", False), ("b", 5, "x", True), ("b", 6, "x", True), ("a", 7, "completed", False), ("b", 8, "failed", False), ("a", 9, "", True)]
EVENTS = [("a", 1, "added", 1), ("a", 4, "updated", 2), ("a", 9, "removed", 3), ("b", 3, "added", 1), ("b", 5, "removed", 2), ("b", 8, "added", 3)]


def log(spark, rows):
    names = [f.split(" ")[0] for f in history.LOG.split(", ")]
    return spark.createDataFrame([tuple({"id": i, "seq": q, "status": s, "removed": r}.get(n) for n in names) for i, q, s, r in rows], history.LOG)


def test_events_of_a_log(spark):
    odd = [(None, 1, "x", False), ("c", None, "x", False), ("d", 1, "x", True), ("a", 4, "completed", False)]
    got = sorted(tuple(r) for r in history.change_events(log(spark, LOG + odd)).collect())
    assert got == EVENTS
    assert history.change_events(log(spark, [])).collect() == []


def test_events_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    try:
        for at in (0, 4, 6):
            log(spark, LOG[at : {0: 4, 4: 6, 6: 9}[at]] + LOG[:at][-1:]).coalesce(1).write.mode("append").json(source)
            stream = history.follow_changes(spark.readStream.schema(history.LOG).json(source))
            query = stream.writeStream.format("json").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
            query.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.read.schema(history.CHANGE).json(out).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == EVENTS
