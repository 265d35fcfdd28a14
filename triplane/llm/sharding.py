"""Sharding by a k-d tree over document metadata, with distributed weighted medians.

Groups of equal texts are the points; a group weighs the bytes of all its documents.  Dimensions are
the text's size (log scale) and the group's source and language (as stable positions in [0, 1)); a
node is cut along its widest dimension at the weighted quantile that its leaf counts ask for, level by
level, until every node is one leaf of the target bytes.  Medians are found by refining
histograms: each round one aggregation over all nodes of the level, and running sums over a node's
at most ``2**BITS`` bins, narrow each node's cut by ``2**BITS``.  Nodes, histograms and cuts are tables
that the driver never sees, so the number of leaves may grow with the input; a level is one job.  Points
that tie in a dimension are ordered by their text's hash, so a value that a third of all bytes
share is cut as finely as any other.

Defined results: null text weighs 8 bytes and is one group with the empty text; null source or
language is a value of its own; repeated rows are separate documents of one group; null doc_ids
are kept; other columns are ignored.  Fewer groups than shards leave shards empty.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplane.llm import scratch

BITS, ROUNDS = 11, 4
_KEY_BITS = BITS * ROUNDS
_GROUP = ["size", "text_crc32", "text_hash"]


def _unit(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("binary")), F.lit(0)) / F.lit(float(1 << 32))


#: Columns that say how a node is cut.
_NODE = ["first", "shards", "dim", "lo", "width", "total", "goal"]
#: Nodes whose table (100 bytes a row) is broadcast; beyond it the joins are left to the planner.
BROADCAST_NODES = 200_000


def _cut_bins(bins: DataFrame) -> DataFrame:
    """Each node's bin that holds its goal (or its last one): node, key, before, last and _NODE.

    ``bins`` has node, key (so far), w (a bin's weight), before (the weight under all bins) and _NODE.
    """
    order = Window.partitionBy("node").orderBy("key")
    upto = bins.withColumn("upto", F.col("before") + F.sum("w").over(order))
    # The first bin that passes the goal; without one the last bin.
    rank = F.struct((F.col("upto") <= F.col("goal")).alias("under"), F.when(F.col("upto") > F.col("goal"), F.col("key")).otherwise(-F.col("key")))
    kept = F.struct("key", (F.col("upto") - F.col("w")).alias("before"), F.col("w").alias("last"), *_NODE)
    return upto.groupBy("node").agg(F.min_by(kept, rank).alias("b")).select("node", "b.*")


def _by_dim(values: list[Column], test) -> Column:
    """The value of the first dimension that passes the test."""
    out = F.when(test(0), values[0])
    for k in range(1, len(values)):
        out = out.when(test(k), values[k])
    return out


def _level(groups: DataFrame, dims: list[str], small) -> DataFrame:
    """Cut every node of several shards and points once; one job, in which only sums move."""
    half = _KEY_BITS // 2
    open_ = groups.where("shards > 1")
    spans = [F.max(d) - F.min(d) for d in dims]
    widest = F.greatest(*spans)
    stats = open_.groupBy("node", "first", "shards").agg(
        _by_dim([F.lit(k) for k in range(len(dims))], lambda k: spans[k] == widest).alias("dim"),
        _by_dim([F.min(d) for d in dims], lambda k: spans[k] == widest).alias("lo"),
        F.greatest(widest, F.lit(1e-12)).alias("width"),
        F.sum("weight").cast("double").alias("total"),
        F.count("*").alias("points"),
    )
    stats = stats.where("points > 1").select("node", "first", "shards", "dim", "lo", "width", "total", (F.col("total") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("goal"))
    place = (_by_dim([F.col(d) for d in dims], lambda k: F.col("dim") == k) - F.col("lo")) / F.col("width")
    place = F.least(F.floor(place * (1 << half)), F.lit((1 << half) - 1)).cast("long")
    key = F.shiftleft(place, half).bitwiseOR(F.shiftrightunsigned("text_hash", 64 - half))
    keyed = open_.drop("first", "shards").join(small(stats), "node").select("node", "weight", *_NODE, key.alias("spot"))
    cuts = None
    for k in range(1, ROUNDS + 1):
        shift = _KEY_BITS - k * BITS
        part = keyed.withColumn("key", F.shiftright("spot", shift))
        if cuts is None:
            part = part.withColumn("before", F.lit(0.0))
        else:
            known = small(cuts.select(F.col("node").alias("n2"), F.col("key").alias("k2"), "before"))
            part = part.join(known, (F.col("node") == F.col("n2")) & (F.shiftright("spot", shift + BITS) == F.col("k2")))
        cuts = _cut_bins(part.groupBy("node", "key", "before", *_NODE).agg(F.sum("weight").cast("double").alias("w")))
    # The boundary bin goes to the nearer side; shards follow the bytes, at least one a side.
    nearer = (F.col("before") + F.col("last") < F.col("total")) & (F.abs(F.col("before") + F.col("last") - F.col("goal")) < F.abs(F.col("before") - F.col("goal")))
    over = (F.col("before") == 0) | nearer
    below = F.when(over, F.col("before") + F.col("last")).otherwise(F.col("before"))
    left = F.greatest(F.lit(1), F.least(F.col("shards") - 1, F.round(F.col("shards") * below / F.col("total")).cast("int")))
    cuts = cuts.select("node", "dim", "lo", "width", F.when(over, F.col("key") + 1).otherwise(F.col("key")).alias("cut"), left.alias("left"))
    moved = groups.join(small(cuts), "node", "left")
    lower = key < F.col("cut")  # NULL for a node that is not cut
    return moved.select(
        *[c for c in groups.columns if c not in ("node", "first", "shards")],
        F.when(lower, 2 * F.col("node") + 1).when(~lower, 2 * F.col("node") + 2).otherwise(F.col("node")).alias("node"),
        F.when(~lower, F.col("first") + F.col("left")).otherwise(F.col("first")).alias("first"),
        F.when(lower, F.col("left")).when(~lower, F.col("shards") - F.col("left")).otherwise(F.col("shards")).alias("shards"),
    )


def tree_shards(groups: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Add ``shard`` to groups (a kept table; columns: dims in [0, 1], weight, text_hash)."""

    def small(nodes: DataFrame) -> DataFrame:
        return F.broadcast(nodes) if shards <= BROADCAST_NODES else nodes

    groups = groups.withColumns({"node": F.lit(0).cast("long"), "first": F.lit(0), "shards": F.lit(shards)})
    level, open_ = 0, shards > 1
    while open_:
        before, groups = groups, scratch.keep(_level(groups, dims, small), "nodes")
        if level:
            scratch.forget(before)
        level += 1
        if 1 << level >= shards:  # a node of one point (fewer groups than shards) has nothing to cut
            open_ = groups.where("shards > 1").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    return groups.select(*[c for c in groups.columns if c not in ("node", "first", "shards")], F.col("first").alias("shard"))


def shard_documents(docs: DataFrame, shards: int | None = 24, target_bytes: int = 1 << 30) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; shards=None: as many as target_bytes asks for."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        _unit(F.col("source")).alias("by_source"),
        _unit(F.col("lang")).alias("by_lang"),
    )
    rows = scratch.keep(rows, "sizes")
    if shards is None:
        shards = max(1, -(-int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // target_bytes))
    groups = rows.groupBy(*_GROUP).agg(F.sum("size").alias("weight"), F.min("by_source").alias("by_source"), F.min("by_lang").alias("by_lang"))
    groups = groups.withColumn("by_size", F.least(F.log2("size") / 40, F.lit(1.0)))
    placed = tree_shards(scratch.keep(groups, "groups"), ["by_source", "by_lang", "by_size"], shards)
    sizes = rows
    rows = scratch.keep(sizes.select("doc_id", *_GROUP).join(placed.select(*_GROUP, "shard"), _GROUP), "placed")
    scratch.forget(sizes)
    out = scratch.ranked(rows, "shard", ["doc_id", *_GROUP], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
