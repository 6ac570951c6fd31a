"""Operator 13: a prefix trie of conversations, by chained prefix digests.

Every prefix of a conversation is a row: its depth and a digest chained over its turns.
Rows of one (depth, digest) are a trie node, so nodes come from one grouping. Its smallest
member owns a node; the nodes that a conversation owns are one run down to its last turn,
since the members below a node are fewer, never others. For sums over subtrees each run
(not each node, which would be quadratic in a long conversation) is exploded to all the
runs above it: a conversation meets at most as many as it has turns. What a run gives to
another enters at the depth where it leaves it, and sums from below are taken along runs.

Chains start anew every CHUNK turns, and the digests that end the chunks are chained in
turn, so a conversation with very many turns is worked on in pieces; positions come from a
range partitioning of all turns, so no task sorts a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, saved, to_batch

#: Turns of a conversation that are chained, and summed, in one piece.
CHUNK = 1024
#: Conversations of a block share its first one's opening turns, this many at most.
BLOCK, MOST_SHARED = 5, 8


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), item (SHA-256 of role and text), n_bytes (of the text) and
    n_turns of every turn, by turn (null first), then role, then text, so ties have one
    order. Null roles and texts are empty; rows without conv_id are left out; repeated rows
    are turns of their own; other columns are ignored."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").alias("turn"), role.alias("role"), text.alias("text")
    ).where("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sized = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    ranged = saved(
        rows.repartitionByRange(*order, F.rand(42))  # a turn repeated very often is split too
        .sortWithinPartitions(*order)
        .select(
            "conv_id",
            F.monotonically_increasing_id().alias("seq"),  # partition and row within it
            F.unhex(F.sha2(sized.cast("binary"), 256)).alias("item"),
            F.octet_length("text").cast("long").alias("n_bytes"),
        ),
        "turns",
    ).withColumn("part", F.shiftright("seq", 33))
    spans = ranged.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("n_turns")
    )
    return ranged.join(spans, ["conv_id", "part"]).select(
        "conv_id", (F.col("seq") - F.col("first") + F.col("skip")).alias("pos"), "item", "n_bytes", "n_turns"
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, length), and their turns (conv_id, depth from 1, item,
    n_bytes, length): conversation c opens with the first h turns of c - c % 5 (as SQL's %:
    towards zero), h being crc32(c) % 9, and goes on with its own after its first h."""
    turns = saved(ordered_turns(conversations), "positions")
    heads = (
        turns.where((F.col("pos") < MOST_SHARED) & (F.col("conv_id") % BLOCK == 0))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "item", "n_bytes"))).alias("head"))
        .select(F.col("conv_id").alias("base"), "head")
    )
    convs = (
        turns.where("pos = 0")
        .select("conv_id", "n_turns", (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
        .withColumn("length", F.size("head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)))
    )
    convs = saved(convs.select("conv_id", "h", "head", "length"), "conversations")
    shared = convs.select("conv_id", F.posexplode("head").alias("pos", "turn"), "length").select(
        "conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "turn.item", "turn.n_bytes", "length"
    )
    own = (
        turns.join(convs, "conv_id")
        .where(F.col("pos") >= F.col("h"))
        .select("conv_id", (F.size("head") + F.col("pos") - F.col("h") + 1).alias("depth"), "item", "n_bytes", "length")
    )
    return convs.select("conv_id", "length"), shared.unionByName(own)


def _chain(rows: DataFrame, keys: list[str], order: str, item: str) -> DataFrame:
    """rows with item replaced by the digest chained over it along order, per keys. Rows
    stream through a sorted partition; one digest is held."""
    names, schema = rows.columns, rows.schema
    at, key_at = names.index(item), [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, b""
        for batch in batches:
            out = []
            for key, value in zip(
                zip(*(batch.column(k).to_pylist() for k in key_at), strict=True), batch.column(at).to_pylist(), strict=True
            ):
                digest = hashlib.sha256((digest if key == last else b"") + value).digest()
                last = key
                out.append(digest)
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, n_bytes and length of every prefix that has a last turn:
    equal digests at a depth mean equal turns up to it."""
    chunk = F.expr(f"(depth - 1) div {CHUNK}").alias("chunk")
    inner = saved(
        _chain(turns.select("conv_id", chunk, "depth", F.col("item").alias("digest"), "n_bytes", "length"), ["conv_id", "chunk"], "depth", "digest"),
        "chained",
    )
    ends = inner.where((F.col("depth") % CHUNK == 0) & (F.col("depth") < F.col("length"))).select("conv_id", "chunk", "digest")
    starts = _chain(ends, ["conv_id"], "chunk", "digest").select(
        "conv_id", (F.col("chunk") + 1).alias("chunk"), F.col("digest").alias("start")
    )
    columns = ["conv_id", "depth", "digest", "n_bytes", "length"]
    later = inner.where("chunk > 0").join(starts, ["conv_id", "chunk"])
    later = later.withColumn("digest", F.unhex(F.sha2(F.concat("start", "digest"), 256)))
    return inner.where("chunk = 0").select(columns).unionByName(later.select(columns))


def _end_digests(ends: DataFrame) -> DataFrame:
    """Per (owner, depth) the SHA-256 of its conv_ids as ascending, comma-joined decimals.
    Ids stream through a sorted partition, so no list of them is held."""
    schema = "owner long, depth long, ends_sha256 string"
    arrow = arrow_schema(ends.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for owner, depth, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (owner, depth) == node:
                    state.update(b",%d" % conv)
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(b"%d" % conv)
            if done:
                yield to_batch(dict(zip(arrow.names, map(list, zip(*done, strict=True)), strict=True)), arrow)
        if node is not None:
            yield to_batch({"owner": [node[0]], "depth": [node[1]], "ends_sha256": [state.hexdigest()]}, arrow)

    return ends.select("owner", "depth", "conv_id").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(run, schema)


def _from_below(nodes: DataFrame, *names: str) -> DataFrame:
    """nodes (conv_id, depth, chunk, ...) with each named column summed over its run's
    nodes of the same depth or more: within chunks, then over the chunks behind."""
    totals = nodes.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(c) for c in names], F.max("more").alias("more"))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.where("more").select("conv_id", "chunk", *[F.sum(c).over(behind).alias(f"{c}_later") for c in names])
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth"))
    summed = nodes.withColumns({c: F.sum(c).over(within) for c in names})
    several = summed.where("more").join(later, ["conv_id", "chunk"])
    several = several.withColumns({c: F.col(c) + F.coalesce(f"{c}_later", F.lit(0)) for c in names}).select(nodes.columns)
    return summed.where("NOT more").select(nodes.columns).unionByName(several)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per trie node of the conversations (conv_id, length) with these turns
    (conv_id, depth, item, n_bytes, length): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    The root (depth 0) has every conversation as a member, with or without turns. Without
    conversations there is no node at all."""
    prefix = saved(prefixes(turns), "prefixes")
    nodes = prefix.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"))
    marked = saved(prefix.join(nodes, ["depth", "digest"]).drop("digest"), "marked")
    owns = F.col("owner") == F.col("conv_id")
    saving = (F.col("n_convs") - 1) * F.col("n_bytes")

    runs = (
        marked.groupBy("conv_id")
        .agg(
            F.min(F.when(owns, F.col("depth"))).alias("top"),
            F.sum(F.when(owns, saving)).alias("saved"),
            F.max(F.when(~owns, F.struct("depth", "owner"))).alias("above"),
            F.max("length").alias("length"),
        )
        .where("top IS NOT NULL")
    )
    runs = saved(runs, "runs")
    kids = runs.where("above IS NOT NULL").groupBy(F.col("above.owner").alias("conv_id"), F.col("above.depth").alias("depth")).agg(F.count(F.lit(1)).alias("kids"))
    kids = saved(kids, "kids")
    at_end = kids.select("conv_id", F.col("depth").alias("length"), F.lit(0).cast("long").alias("leaf"))
    runs = saved(runs.join(at_end, ["conv_id", "length"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(1).cast("long"))), "leaves")
    # every run, exploded to all runs above it: where it leaves each
    above = marked.where(~owns).groupBy("conv_id", "owner").agg(F.max("depth").alias("depth"))
    given = (
        above.join(runs.select("conv_id", "saved", "leaf"), "conv_id")
        .groupBy(F.col("owner").alias("conv_id"), "depth")
        .agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    )
    no_turn = convs.where("length = 0").select(F.lit(0).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id")
    ends = saved(_end_digests(marked.where("depth = length").select("owner", "depth", "conv_id").unionByName(no_turn)), "ends")

    def facts(rows: DataFrame, **given_columns: Column) -> DataFrame:
        kinds = {"n_convs": "long", "kids": "long", "saved": "long", "leaf": "long", "parent": "long", "ends_sha256": "string", "more": "boolean"}
        return rows.select(
            "conv_id", "depth", *[given_columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        )

    known = (
        facts(
            marked.where(owns),
            n_convs=F.col("n_convs"),
            saved=saving,
            kids=F.when(F.col("depth") < F.col("length"), 1).otherwise(0),
            more=F.col("length") > CHUNK,
        )
        .unionByName(facts(kids, kids=F.col("kids")))
        .unionByName(facts(given, saved=F.col("saved"), leaf=F.col("leaf")))
        .unionByName(facts(runs.withColumn("depth", F.col("length")), leaf=F.col("leaf")))
        .unionByName(facts(runs.withColumn("depth", F.col("top")), parent=F.col("above.owner")))
        .unionByName(facts(ends.where("depth > 0").withColumn("conv_id", F.col("owner")), ends_sha256=F.col("ends_sha256")))
        .withColumn("chunk", F.expr(f"(depth - 1) div {CHUNK}"))
        .repartition("conv_id", "chunk")
        .groupBy("conv_id", "chunk", "depth")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_convs", "kids", "saved", "leaf")],
            *[F.max(c).alias(c) for c in ("parent", "ends_sha256", "more")],
        )
    )
    summed = _from_below(saved(known, "nodes"), "saved", "leaf")

    top = convs.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    below = runs.agg(
        F.coalesce(F.count(F.when(F.col("top") == 1, 1)), F.lit(0)).alias("kids"),
        F.coalesce(F.sum("leaf"), F.lit(1)).alias("leaf"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
    )
    ended = ends.where("depth = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    top = saved(top.crossJoin(F.broadcast(below)).crossJoin(F.broadcast(ended)), "root")  # one row each
    first = top.first()
    root_id = first["root"] if first else None

    none = F.lit(hashlib.sha256(b"").hexdigest())
    inner = summed.select(
        "conv_id",
        "depth",
        F.coalesce("parent", F.when(F.col("depth") == 1, F.lit(root_id).cast("long")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs",
        F.col("kids").alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return inner.unionByName(
        top.select(
            F.col("root").alias("conv_id"),
            F.lit(0).cast("long").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            "n_convs",
            F.col("kids").alias("n_children"),
            F.col("leaf").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see rebuilt and prefix_trie."""
    return prefix_trie(*rebuilt(conversations))
