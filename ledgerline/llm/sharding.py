"""Operator 7: sharding by a hierarchical weighted hash tree, in SQL functions only.

A row descends region, rack and shard. At each level every child of the chosen node
makes a weighted draw, ln(u) / weight, where u comes from a hash of the row's key and
the child's own path; the largest draw wins. A child's draw depends on nothing but the
key, its path and its weight, so changing the weights below one node moves rows only
into (or out of) that subtree: rows that chose another region, and whose region's weight
did not grow, keep their shard.

Placing a new shard in a region of its own therefore moves rows into that shard alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes that a row costs beside its text.
ROW_OVERHEAD = 16
#: Rows that one numbering task orders, about; see with_slots.
ROWS_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[tuple[int, float], ...]

    @property
    def weight(self) -> float:
        return sum(w for _, w in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


def even_tree(n_shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> tuple[Region, ...]:
    """n_shards of weight 1 in full regions; each shard left over gets its own region,
    so that going from a whole number of regions to one shard more moves rows into the
    new shard only."""
    size = racks_per_region * shards_per_rack
    full, regions = n_shards // size, []
    for g in range(full):
        racks = []
        for r in range(racks_per_region):
            first = g * size + r * shards_per_rack
            racks.append(Rack(f"g{g}.r{r}", tuple((first + k, 1.0) for k in range(shards_per_rack))))
        regions.append(Region(f"g{g}", tuple(racks)))
    for s in range(full * size, n_shards):
        regions.append(Region(f"s{s}", (Rack(f"s{s}.r0", ((s, 1.0),)),)))
    return tuple(regions)


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """ln(u) / weight for u in (0, 1], from 52 bits of the hash of key and path."""
    bits = F.shiftrightunsigned(F.xxhash64(key, path), 12)
    u = (bits.cast("double") + F.lit(1.0)) / F.lit(float(1 << 52))
    return F.ln(u) / weight


def _descend(key: Column, node: Column, children: dict[str, list[tuple[str, float]]]) -> Column:
    """The path of the node's child with the largest draw; on a tie, of the first."""
    below = F.create_map(
        *[
            x
            for path, kids in children.items()
            for x in (
                F.lit(path),
                F.array(*[F.struct(F.lit(k).alias("path"), F.lit(float(w)).alias("weight")) for k, w in kids if w > 0]),
            )
        ]
    )
    drawn = F.transform(
        below[node],
        lambda c, i: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), (-i).alias("at"), c["path"].alias("path")),
    )
    return F.array_max(drawn)["path"]


def shard_of(key: Column, tree: tuple[Region, ...]) -> Column:
    """The shard of a long key; null keys draw like the key -1. Nodes of weight 0 get
    nothing."""
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    live = [g for g in tree if g.weight > 0]
    region = _descend(key, F.lit("root"), {"root": [(g.name, g.weight) for g in live]})
    rack = _descend(key, region, {g.name: [(r.name, r.weight) for r in g.racks] for g in live})
    racks = [r for g in live for r in g.racks if r.weight > 0]
    leaf = _descend(key, rack, {r.name: [(f"{r.name}.{s}", w) for s, w in r.shards] for r in racks})
    return F.substring_index(leaf, ".", -1).cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], n_rows: int) -> DataFrame:
    """Adds slot, gapless from 0 within each shard, without ordering a whole shard in one
    task: rows are numbered inside (shard, bucket) and a prefix sum over the small table
    of bucket counts places each bucket. The counts have shards x buckets rows, and
    buckets is n_rows over ROWS_PER_BUCKET and the number of shards."""
    n_buckets = max(8, n_rows // ROWS_PER_BUCKET)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit("slot")), F.lit(n_buckets)))
    rank = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = (
        df.groupBy(shard, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(shard).alias("_shard"),
            F.col("_bucket").alias("_b"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        )
    )
    return (
        df.withColumn("_rank", rank)
        .join(counts, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .drop("_bucket", "_rank", "_shard", "_b", "_before")
    )


def assign_shards(
    docs: DataFrame,
    tree: tuple[Region, ...],
    grown: tuple[Region, ...] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only the key and the shape of the tree decide a row's shard (law "key"). Null texts
    count as empty: size 16, checksum 0. Null ids are kept and share one shard. Repeated
    rows share a shard and get slots of their own. An empty table gives an empty result.
    Other columns of the input are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.col(f"`{id_col}`").cast("long")
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    out = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
