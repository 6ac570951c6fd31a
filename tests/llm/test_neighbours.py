"""Operator 12 against brute force."""

import math

import numpy as np

from ledgerline.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n, seed=1, d=24, groups=9):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, d))
    x = centres[r.integers(0, groups, n)] + 0.6 * r.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def exact(ids, x, k=20, every=20):
    x = x.astype(np.float64)
    out = {}
    for q in [i for i in range(len(ids)) if ids[i] % every == 0]:
        s = np.zeros(len(x))
        for j in range(x.shape[1]):
            s += x[q, j] * x[:, j]
        order = sorted((-s[c], ids[c]) for c in range(len(ids)) if ids[c] != ids[q])[:k]
        out[ids[q]] = [(i, -s) for s, i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], SCHEMA)


def test_few_rows_are_exact(spark):
    ids, x = list(range(0, 900, 3)), clustered(300)
    assert found(neighbours.nearest_neighbours(frame(spark, ids, x))) == exact(ids, x)


def test_recall_of_routing(spark):
    ids, x = list(range(6000)), clustered(6000, 2)
    settings = neighbours.Settings(rows=256, sample=3000, piece=200)
    df = frame(spark, ids, x)
    router = neighbours.train(neighbours.vectors_of(df), 6000, settings)
    assert router.weights.shape[1] == 16 and router.probes < 12
    got, want = found(neighbours.nearest_neighbours(df, settings=settings)), exact(ids, x)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, rows in got.items():  # true scores, in order
        true = {i: s for i, s in exact(ids, x, k=6000, every=q or 7000)[q]} if q in (0, 20) else None
        assert true is None or all(true[i] == s for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_partitions_are_balanced_and_cut_few_edges():
    x = neighbours._unit(clustered(2000, 3).astype(np.float64))
    graph = neighbours.neighbour_graph(x, 10)
    label = neighbours.balanced_partitions(x, graph, 8, 8)
    assert np.bincount(label, minlength=8).max() <= 275
    assert (label[graph] == label[:, None]).mean() > 0.5 > 4 / 8 - 0.1


def test_very_common_vector_is_cut_into_pieces(spark):
    x = clustered(1500, 4)
    x[::3] = x[0]
    ids = list(range(1500))
    settings = neighbours.Settings(rows=128, sample=1000, piece=64)
    got, want = found(neighbours.nearest_neighbours(frame(spark, ids, x), settings=settings)), exact(ids, x)
    for q in (0, 60, 120):  # copies of it: exactly the copies of least id
        assert got[q] == want[q]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (2, [-1.0, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (20, [0.0, 2.0]), (40, None)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA + ", v int, partition string")
    assert found(neighbours.nearest_neighbours(df)) == {
        0: [(1, 3.0), (2, 3.0), (20, 0.0), (20, 0.0), (2, -1.0)],
        20: [(1, 2.0), (2, 2.0), (2, 1.0), (0, 0.0)],
    }
    assert math.isclose(neighbours._unit(np.array([[1e200, 1e200]]))[0, 0], 0.5**0.5)


def test_empty_and_single(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neighbours.nearest_neighbours(spark.createDataFrame([(0, [1.0])], SCHEMA)).collect() == []
