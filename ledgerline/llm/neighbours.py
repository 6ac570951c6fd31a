"""Operator 12: approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gets a graph of its nearest neighbours (largest inner
product), which is cut into partitions of equal size that few edges cross: halves by the
widest direction, then moves to the partition that holds most of a vector's neighbours,
as far as sizes allow. A small classifier (multinomial logistic regression) learns from a
vector where its neighbours are. It files every row of the table under its most probable
partition, and sends a query to its several most probable ones, where all rows are ranked
by the exact measure. How many partitions a query needs is read off the sample, whose
neighbours are known: as many as find the wanted share of them.

A query first asks its most probable partition. The k-th score found there goes with it to
the others, which answer only with rows that reach it, so few rows are merged.

Rows are shuffled by (partition, piece); pieces hold a bounded number of rows, so a
partition with very many equal vectors is many groups, each of which answers with its best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, saved, to_batch


@dataclass(frozen=True)
class Settings:
    """k: neighbours a query gets. sample: vectors that the model is fitted on, at most.
    rows: of the table per partition, as far as most partitions are enough. target: share
    of the sample's own neighbours that routing must find. piece: rows ranked at once."""

    k: int = 20
    sample: int = 16384
    rows: int = 1024
    partitions: int = 256
    edges: int = 12
    target: float = 0.94
    piece: int = 8192
    rounds: int = 8
    epochs: int = 40


@dataclass
class Router:
    weights: np.ndarray  # (dimensions + 1, partitions), on vectors of length 1
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions by falling probability, per row."""
        return np.argsort(-_scores(x, self.weights), axis=1, kind="stable").astype(np.int32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _unit(x) @ weights[:-1] + weights[-1]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Per row the k other rows of largest inner product, best first."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable")
        out[at : at + 512] = np.take_along_axis(top, order, axis=1)
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """A partition per row, a power of two of them, none over 1.1 times the mean size."""
    label, rng = np.zeros(len(x), np.int64), np.random.default_rng(7)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            own = np.flatnonzero(label == p)
            centred = x[own] - x[own].mean(axis=0)
            axis = rng.standard_normal(x.shape[1])
            for _ in range(12):  # towards the direction of most variance
                axis = centred.T @ (centred @ axis)
                axis /= np.linalg.norm(axis) or 1.0
            upper = own[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]]
            label[upper] += 1 << level
    most = int(np.ceil(1.1 * len(x) / parts))
    sizes = np.bincount(label, minlength=parts)
    back = np.argsort(graph.ravel(), kind="stable")  # edges count both ways
    ends = np.searchsorted(graph.ravel()[back], np.arange(len(x) + 1))
    sources = back // graph.shape[1]
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(len(x)).tolist():
            around = np.concatenate([graph[v], sources[ends[v] : ends[v + 1]]])
            votes = np.bincount(label[around], minlength=parts)
            votes[(sizes >= most) & (np.arange(parts) != label[v])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[label[v]]:
                sizes[label[v]] -= 1
                sizes[best] += 1
                label[v] = best
                moved += 1
        if moved * 200 < len(x):
            break
    return label


def fit(x: np.ndarray, parts: int, settings: Settings) -> Router:
    """The router learned from a sample, whose rows are vectors that take part."""
    parts = 1 << max(0, min(parts, len(x) // 8).bit_length() - 1) if len(x) >= 16 else 1
    if parts == 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1)
    graph = neighbour_graph(x, max(settings.edges, settings.k))
    label = balanced_partitions(_unit(x), graph[:, : settings.edges], parts, settings.rounds)
    # where a vector and its neighbours are, in shares
    wanted = np.zeros((len(x), parts), np.float32)
    for column in (np.arange(len(x)), *graph[:, : settings.edges].T):
        np.add.at(wanted, (np.arange(len(x)), label[column]), 1)
    wanted /= wanted.sum(axis=1, keepdims=True)
    inputs = np.hstack([_unit(x), np.ones((len(x), 1))]).astype(np.float32)
    w = np.zeros((inputs.shape[1], parts), np.float32)
    first, second, step, rng = np.zeros_like(w), np.zeros_like(w), 0, np.random.default_rng(11)
    for _ in range(settings.epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            s = inputs[rows] @ w
            s = np.exp(s - s.max(axis=1, keepdims=True))
            gradient = inputs[rows].T @ (s / s.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    router = Router(w.astype(np.float64), parts)
    ranked = router.ranked(x)
    place = np.empty_like(ranked)  # of each partition in a row's order
    np.put_along_axis(place, ranked, np.arange(parts, dtype=np.int32)[None, :], axis=1)
    near = graph[:, : settings.k]
    at = np.take_along_axis(place, ranked[near.ravel(), 0].reshape(near.shape), axis=1)
    reached = np.cumsum(np.bincount(at.ravel(), minlength=parts)) / at.size
    router.probes = min(parts, int(np.searchsorted(reached, settings.target)) + 1)
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls and of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component on."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * c[:, j]
    return total


def best_of(
    query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's position, id, score) of each query's k best rows, other than its own id, of
    those that reach its floor."""
    found: list[tuple[np.ndarray, ...]] = []
    lengths = np.sqrt((rows * rows).sum(axis=1)).max()
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        s = q @ rows.T
        s[ids[None, :] == query_ids[at : at + 256, None]] = -np.inf
        # products summed in another order differ by rounding: keep what that could bring in
        margin = 1e-12 * len(q[0]) * lengths * np.sqrt((q * q).sum(axis=1))
        last = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
        last = np.maximum(last, floors[at : at + 256])
        i, j = np.nonzero((s >= (last - margin)[:, None]) & (s > -np.inf))
        score = _dots(q[i], rows[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[rank < k] + at, ids[j[rank < k]], score[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def vectors_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (floats, or else doubles) of the rows that take part: with an id, and a
    vector that is not null, empty or zero and has only finite components."""
    v = F.col("v")
    kind = embeddings.schema[vector_col].dataType.simpleString()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite & F.exists(v, lambda x: x != 0))


RESULT = "query_id long, vec_id long, score double"


def _search(rows: DataFrame, k: int) -> DataFrame:
    """Best rows for the queries of each (partition, piece); rows (partition, piece, asks,
    vec_id, v, floor) stream through sorted partitions, one piece's vectors are held."""
    arrow = arrow_schema(rows.sparkSession, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []
        for batch in batches:
            names = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            vec_id = batch.column(3).to_numpy()
            changes = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1) | (asks[1:] != asks[:-1])))
            for a, b in zip(changes.tolist(), [*changes[1:].tolist(), len(names)], strict=True):
                own = tuple(names[a])
                if own != key:
                    key, ids, held = own, [], []
                x = _matrix(batch.column(4).slice(a, b - a))
                if not asks[a]:
                    ids.append(vec_id[a:b])
                    held.append(x)
                elif ids:
                    if len(ids) > 1:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    floors = batch.column(5).slice(a, b - a).to_numpy(zero_copy_only=False)
                    i, found, score = best_of(vec_id[a:b], x, floors, ids[0], held[0], k)
                    yield to_batch({"query_id": pa.array(vec_id[a:b][i]), "vec_id": pa.array(found), "score": pa.array(score)}, arrow)

    return rows.repartition("partition", "piece").sortWithinPartitions("partition", "piece", "asks").mapInArrow(run, RESULT)


def train(vectors: DataFrame, n: int, settings: Settings) -> Router:
    """A router fitted on the rows of least hash, settings.sample at most, each vector once."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(settings.sample).collect()
    x = np.unique(np.array([r["v"] for r in sample], np.float64), axis=0)
    parts = 1 << max(0, (min(settings.partitions, n // settings.rows)).bit_length() - 1)
    return fit(x, parts, settings)


def nearest_neighbours(
    embeddings: DataFrame,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    settings: Settings = Settings(),  # noqa: B008
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product of the original vectors) of
    the k nearest found for each row whose id every divides, among all rows but its own.

    Ties go to the smaller id. Rows without an id, and vectors that are null, empty, zero
    or hold a null or non-finite component, take no part; nor do vectors of another length
    than most have (ties: the longest). Rows that share a query's id are its own; a
    repeated id asks once, with its least vector, but each of its rows is a candidate. An
    empty table, or one with a single id, gives no row; other columns are ignored."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = embeddings.sparkSession
    vectors = saved(vectors_of(embeddings, id_col, vector_col), "vectors")
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("v") == sizes["d"])
    router = train(vectors, sizes["n"], settings)

    def routed(batches: Iterator[pa.RecordBatch], probes: int, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ranked = router.ranked(_matrix(batch.column(1)))
                # on past partitions that hold fewer than k other rows together
                enough = (np.cumsum(sizes[ranked], axis=1) <= settings.k).sum(axis=1) + 1
                taken = np.arange(ranked.shape[1]) < np.maximum(enough, probes)[:, None]
                ends = np.append(0, np.cumsum(taken.sum(axis=1))).astype(np.int32)
                flat = pa.ListArray.from_arrays(ends, pa.array(ranked[taken]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["vec_id", "v", "partitions"])

    filed = f"vec_id long, v {vectors.schema['v'].dataType.simpleString()}, partitions array<int>"
    parts = len(router.weights[0])
    index = saved(
        vectors.mapInArrow(lambda b: routed(b, 1, np.full(parts, settings.k + 1)), filed).select(F.col("partitions")[0].alias("partition"), "vec_id", "v"), "index"
    )
    counts = index.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition of the router
    held = np.zeros(parts, np.int64)
    for r in counts:
        held[r["partition"]] = r["n"]
    pieces = F.element_at(F.array(*[F.lit(-(-int(n) // settings.piece)) for n in held]), F.col("partition") + 1)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = saved(
        asked.mapInArrow(lambda b: routed(b, router.probes, held), filed)
        .select("vec_id", "v", F.posexplode("partitions").alias("turn", "partition"))
        .withColumn("piece", F.explode(F.slice(F.sequence(F.lit(0), pieces), 1, pieces))),
        "asked",
    )
    listed = index.select(
        "partition", F.pmod(F.xxhash64("vec_id", "v"), pieces).cast("int").alias("piece"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("double").alias("floor")
    )

    def answers(questions: DataFrame, floor: Column) -> DataFrame:
        asks = questions.select("partition", "piece", F.lit(True).alias("asks"), "vec_id", "v", floor.alias("floor"))
        return _search(listed.unionByName(asks), settings.k)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)

    lowest = float("-inf")
    found = saved(best(answers(asked.where("turn = 0"), F.lit(lowest))), "first")
    if parts > 1:
        floors = found.where(F.col("rank") == settings.k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
        further = asked.where("turn > 0").join(floors, "vec_id", "left")
        found = best(found.drop("rank").unionByName(answers(further, F.coalesce("kth", F.lit(lowest)))))
    return found.select("query_id", "rank", "vec_id", "score")
