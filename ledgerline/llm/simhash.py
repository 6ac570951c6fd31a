"""Operator 4: SimHash near-duplicates by sharded BK-trees.

Every document has a 64-bit fingerprint. Two fingerprints at distance 2 or less agree in
at least two of four 16-bit blocks, so distinct fingerprints are dealt to six families of
shards, one for each pair of blocks, keyed by those 32 bits. Each shard holds a BK-tree:
children hang from their parent by integer Hamming distance, and a search follows only
edges within the radius of its own distance. A shard returns the links that join its
fingerprints, one per fingerprint at most, and connected components are found over them.

Shards over a limit are dealt again by a third of their other 32 bits (of three parts, one
agrees at distance 2), and those still over it, whose fingerprints share 42 bits or more,
are cut into trees of limited size, each searched by the fingerprints of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bytes_of, keyed, map_batches, saved

SEED = 42
RADIUS = 2
#: Fingerprints that one tree may hold.
SHARD_LIMIT = 2048
FAMILIES = list(combinations(range(4), 2))
#: Rows of one fingerprint beyond which they are not shuffled by it.
HOT_ROWS = 1 << 20


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The SimHash of a UTF-8 text's word shingles."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
    ends = (ends - 1).tolist()
    span = min(width, n)
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), n - span + 1
    for at in range(0, count, 1 << 16):
        upto = min(at + (1 << 16), count)
        h = np.fromiter(
            (digest(text[a:b], SEED) for a, b in zip(starts[at:upto], ends[at + span - 1 : upto + span - 1], strict=True)),
            ">u8",
            upto - at,
        )
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, per input row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column("doc_id"),
            "fp": [signed(fingerprint(raw)) for raw in bytes_of(batch.column("text"))],
        }

    return map_batches(keyed(docs, id_col, text_col), run, "doc_id long, fp long")


def _links(members: np.ndarray, searching: np.ndarray | None, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """Builds the BK-tree of members and runs all searches through it at once. Yields
    (position of a tree node, positions of the searching fingerprints it links)."""
    queries = members if searching is None else searching
    stack = [(np.arange(len(members)), np.arange(len(queries)))]
    while stack:
        tree, asking = stack.pop()
        node, rest = tree[0], tree[1:]
        d = np.bitwise_count(queries[asking] ^ members[node]).astype(np.int16)
        near = asking[d <= radius]
        if len(near):
            yield int(node), near
        if not len(rest):
            continue
        edge = np.bitwise_count(members[rest] ^ members[node]).astype(np.int16)
        for k in np.unique(edge).tolist():
            follow = asking[np.abs(d - k) <= radius]
            if len(follow):
                stack.append((rest[edge == k], follow))


def shard_links(fps: np.ndarray, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that join exactly what the shard's fingerprints within the
    radius of each other join, at most one per fingerprint. With sides, the tree holds
    those of side 0 and those of side 1 search it."""
    if sides is None:
        order, tree, queries, shift = np.unique(fps), None, None, 0
        tree = order
    else:
        tree, queries = np.unique(fps[sides == 0]), np.unique(fps[sides == 1])
        order, shift = np.concatenate([tree, queries]), len(tree)
        if not len(tree) or not len(queries):
            return order[:0], order[:0]
    label = np.arange(len(order))
    for node, near in _links(tree, queries):
        near = near + shift
        own = label[near]
        if (own == label[node]).all():
            continue
        merged = np.unique(np.append(own, label[node]))
        label[np.isin(label, merged)] = merged[0]
    moved = np.flatnonzero(label != np.arange(len(order)))
    a, b = order[moved], order[label[moved]]
    return np.maximum(a, b), np.minimum(a, b)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, which holds whole shards: (shard, fp, side)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    shard, fp, side = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(shard, kind="stable")
    shard, fp, side = shard[order], fp[order].view(np.uint64), side[order]
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    size = np.diff(np.append(first, len(shard)))
    found = []
    for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        own = side[at : at + n]
        a, b = shard_links(fp[at : at + n], own if own.min() >= 0 else None)
        if len(a):
            found.append((a, b))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(both[:, k].copy().view(np.int64)) for k in (0, 1)], names=["a", "b"]
        )


def _bits(fp, low: int, n: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))


def near_links(distinct: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) between the fingerprints of a table with one column fp, no repeats."""
    fp = F.col("fp")
    key = lambda i, j: F.shiftleft(_bits(fp, 16 * i, 16), 16).bitwiseOR(_bits(fp, 16 * j, 16))
    dealt = distinct.select(
        "fp",
        F.posexplode(F.array(*[key(i, j) for i, j in FAMILIES])).alias("family", "key"),
    ).select("fp", "family", F.xxhash64("family", "key").alias("shard"))

    def crowded(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        return saved(sizes.select(F.col("shard").alias("hot"), "n"), name)

    def parted(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            rows.join(hot, rows.shard == hot.hot, "left_anti"),
            rows.join(hot, rows.shard == hot.hot),
        )

    none = F.lit(-1).cast("int").alias("side")
    hot = crowded(dealt, "crowded")
    if hot.isEmpty():
        rows = dealt.select("shard", "fp", none)
    else:
        calm, over = parted(dealt, hot)
        # the blocks that the family's key leaves free, as 32 bits in parts of 11, 11, 10
        free = F.lit(None)
        for f, pair in enumerate(FAMILIES):
            i, j = (x for x in range(4) if x not in pair)
            free = F.when(F.col("family") == f, key(i, j)).otherwise(free)
        again = (
            over.withColumn("free", free)
            .select(
                "fp",
                "shard",
                F.posexplode(F.array(_bits(F.col("free"), 0, 11), _bits(F.col("free"), 11, 11), _bits(F.col("free"), 22, 10))).alias("part", "bits"),
            )
            .select("fp", F.xxhash64("shard", "part", "bits").alias("shard"))
        )
        still = crowded(again, "crowded-again")
        rows = calm.select("shard", "fp", none)
        if still.isEmpty():
            rows = rows.unionByName(again.select("shard", "fp", none))
        else:
            calm, over = parted(again, still)
            trees = F.ceil(F.col("n") / limit).cast("int")
            own = F.pmod(F.xxhash64("fp"), trees).cast("int")
            other = F.explode(F.sequence(F.lit(0), trees - 1)).alias("other")
            tiles = over.select("fp", "shard", own.alias("own"), other).select(
                F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"),
                "fp",
                F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
            )
            rows = rows.unionByName(calm.select("shard", "fp", none)).unionByName(tiles)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "shard").mapInArrow(_search, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b) that reaches a lesser one, root
    being the least. Alternates large-star and small-star rounds, each written to the shared
    folder, until nothing changes; minima are pre-aggregated and joined back, so that a
    node with very many links is no task of its own."""

    def minima(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    edges = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(minima(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        small = large.join(minima(large), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = saved(small.where("u <> v").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the
    smallest doc_id reachable over links of distance 2 or less), fp (the fingerprint as
    a signed long), root (the component's own name, a fingerprint).

    Texts without words, null ones too, have fingerprint 0 and link like any other.
    Repeated rows are kept. Null ids never become a component_id, unless a component has
    no other: then it is null. An empty table gives an empty result; other columns of the
    input are ignored.
    """
    prints = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    return grouped(prints)


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with one more column, the fingerprint of each row's text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([signed(fingerprint(raw)) for raw in bytes_of(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def grouped(prints: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """near_duplicates() from rows of doc_id and fp. Fingerprints of over hot_rows rows (of N
    rows, at most N / hot_rows are such) meet their rows in a broadcast, the others in a
    shuffle."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = saved(least, "distinct-fingerprints")
    roots = saved(components(near_links(least.select("fp"))), "roots")
    member = least.join(roots, least.fp == roots.node, "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = member.join(of_root, "root").select(F.col("fp").alias("_fp"), "component_id", "root", "n")
    hot = F.col("n") > hot_rows
    if least.where(hot).isEmpty():
        rows = prints.join(of_fp, prints.fp == F.col("_fp"))
    else:
        of_fp = saved(of_fp, "components")
        few = F.broadcast(of_fp.where(hot))
        calm = prints.join(few, prints.fp == F.col("_fp"), "left_anti")
        rows = prints.join(few, prints.fp == F.col("_fp")).unionByName(calm.join(of_fp, calm.fp == F.col("_fp")))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root")
