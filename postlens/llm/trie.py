"""Operator 12: the prefix trie of conversations, rolled up in depth bands.

A node is a distinct sequence of first turns. It is known by its depth and 128 bits that its turns
add up to: each turn gives two 64-bit hashes of its depth, role and text, and a prefix has the
exclusive or of them. So prefixes are running aggregates, which blocks of turns work out apart.

Sums over subtrees: depths are cut into bands of ``BAND``. Each node adds its values to its
ancestors in its own band, at most ``BAND`` of them. The tops of the bands, with these sums, are
a tree of their own that is ``BAND`` times lower, and are summed in the same way; each top then
adds its whole subtree to its ancestors in the band above. No node emits more than ``BAND`` rows in
a step, and the number of steps is the logarithm of the greatest depth.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.llm.common import prepare, stored
from postlens.operators.joins import join_hot

#: Depths of a band: the most ancestors to which a node adds its values in one step.
BAND = 16
#: Turns of a conversation whose prefixes are worked out together.
BLOCK_TURNS = 4_096
#: Consecutive conversation ids that are listed in one row.
LISTED = 512

NODE = "struct<depth:bigint,a:bigint,b:bigint>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars): the turns of each conversation, numbered from 1.

    The order is by turn, null first, then role, then the md5 of the text. ``a`` and ``b`` are
    hashes of role and text, ``chars`` the code points of the text; a null role or text counts
    as empty. Rows without a conv_id belong to no conversation and are left out.

    Rows are sorted by ranges, so a conversation may hold any share of them; a position is the
    number of its turns in earlier ranges and the place in its own.
    """
    prepare(conversations)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn"), role.alias("role"), F.md5(text).alias("digest"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), F.length(text).cast("long").alias("chars"),
    )
    # The last key tells equal rows apart, so that the sort can divide them.
    ranged = turns.withColumn("row", F.monotonically_increasing_id()).orderBy("conv_id", F.asc_nulls_first("turn"), "role", "digest", "row")
    fixed = stored(ranged.select("conv_id", "a", "b", "chars", F.monotonically_increasing_id().alias("at")), "trie-turns")
    fixed = fixed.withColumn("part", F.shiftright("at", 33))
    counts = fixed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("earlier"))
    inside = fixed.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")).cast("long"))
    return inside.join(earlier, ["conv_id", "part"]).select("conv_id", (F.col("pos") + F.col("earlier")).alias("pos"), "a", "b", "chars")


def with_openings(turns: DataFrame, conversations: DataFrame, of: Column, length: Column, longest: int) -> DataFrame:
    """Each conversation's first turns replaced by those of another one.

    ``turns`` as of ``ordered_turns``; ``conversations`` has each conv_id once. The first ``length``
    turns (at most ``longest``) come from conversation ``of`` (all if it has fewer, none if it is
    absent), then follow the conversation's own turns after its first ``length``.
    """
    plan = conversations.select("conv_id", of.cast("long").alias("source"), length.cast("long").alias("h"))
    first = turns.filter(F.col("pos") <= longest).withColumnRenamed("conv_id", "source")
    taken = plan.join(first, "source").filter("pos <= h").select("conv_id", "pos", "a", "b", "chars")
    known = first.groupBy("source").agg(F.count("*").alias("n"))
    moved = plan.join(known, "source", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("n"))
    own = turns.join(moved, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "a", "b", "chars")
    return taken.unionByName(own)


@dataclass
class Trie:
    """``nodes``: (node, depth, conv_id, chars, parent, n_convs, n_children, parent_conv_id, n_leaves,
    saved); ``ends``: (node, conv_id), the conversations that end in a node."""

    nodes: DataFrame
    ends: DataFrame


def paths_of(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, node, chars, parent, length): every prefix of every conversation, the empty one too.

    ``length`` is the number of turns on the row of a conversation's last prefix, else null.
    """
    marked = turns.select(
        "conv_id", "pos", "chars", F.floor((F.col("pos") - 1) / BLOCK_TURNS).alias("block"),
        F.xxhash64("pos", "a", "b").alias("a"), F.xxhash64("b", "pos", "a").alias("b"),
    )
    blocks = marked.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("all_a"), F.bit_xor("b").alias("all_b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, 1)
    carried = blocks.select(
        "conv_id", "block", F.coalesce(F.bit_xor("all_a").over(before), F.lit(0)).alias("from_a"),
        F.coalesce(F.bit_xor("all_b").over(before), F.lit(0)).alias("from_b"), F.count("block").over(after).alias("more"),
    )
    order = Window.partitionBy("conv_id", "block").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.join(carried, ["conv_id", "block"]).select(
        "conv_id", "pos", "chars", "more", F.lead("pos").over(order).alias("next"),
        F.bit_xor("a").over(upto).bitwiseXOR(F.col("from_a")).alias("node_a"), F.bit_xor("b").over(upto).bitwiseXOR(F.col("from_b")).alias("node_b"),
        F.col("a"), F.col("b"),
    )
    own = F.struct(F.col("pos").alias("depth"), F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    above = F.struct(
        (F.col("pos") - 1).alias("depth"), F.col("node_a").bitwiseXOR(F.col("a")).alias("a"), F.col("node_b").bitwiseXOR(F.col("b")).alias("b")
    )
    last = F.col("next").isNull() & (F.col("more") == 0)
    longer = rows.select("conv_id", own.cast(NODE).alias("node"), "chars", above.cast(NODE).alias("parent"), F.when(last, F.col("pos")).alias("length"))
    with_turns = turns.filter("pos = 1").select("conv_id", F.lit(True).alias("some"))
    root = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("a"), F.lit(0).alias("b")).cast(NODE)
    roots = conversations.select("conv_id").join(with_turns, "conv_id", "left").select(
        "conv_id", root.alias("node"), F.lit(0).cast("long").alias("chars"), F.lit(None).cast(NODE).alias("parent"),
        F.when(F.col("some").isNull(), F.lit(0)).cast("long").alias("length"),
    )
    return longer.unionByName(roots)


def subtree_sums(paths: DataFrame, nodes: DataFrame, values: list[str], deepest: int, step: int = 1) -> DataFrame:
    """(node, conv_id, depth, values…) with each node's values summed over its subtree.

    ``nodes`` has (node, conv_id, depth, values…), one row a node, with depths that are multiples
    of ``step``; conv_id is a member, whose path gives the ancestors.
    """
    wide = step * BAND
    place = F.struct(F.col("node.depth").alias("depth"), "node")
    bands = stored(
        paths.filter(F.col("node.depth") % step == 0).groupBy("conv_id", F.floor(F.col("node.depth") / wide).alias("band"))
        .agg(F.sort_array(F.collect_list(place)).alias("path")), "trie-bands",
    )  # at most BAND entries a row

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(*[F.sum(v).alias(v) for v in values])

    upward = nodes.withColumn("band", F.floor(F.col("depth") / wide)).join(bands, ["conv_id", "band"])
    inside = summed(upward.select(F.explode(F.slice("path", 1, (F.col("depth") % wide / step + 1).cast("int"))).alias("up"), *values).select("up.node", *values))
    known = nodes.select("node", "conv_id", "depth")
    if deepest < wide:
        return known.join(inside, "node")
    inside = stored(known.join(inside, "node"), "trie-band-sums")
    tops = stored(subtree_sums(paths, inside.filter(F.col("depth") % wide == 0), values, deepest, wide), "trie-tops")
    handed = tops.filter("depth > 0").withColumn("band", F.floor(F.col("depth") / wide) - 1).join(bands, ["conv_id", "band"])
    handed = handed.select(F.explode("path").alias("up"), *values).select("up.node", *values)
    whole = summed(inside.select("node", *values).unionByName(handed))
    return known.join(whole, "node")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> Trie:
    """The trie of conversations, one node for each distinct sequence of first turns.

    ``turns`` as of ``ordered_turns`` (positions from 1 on without gaps); ``conversations`` has each
    conv_id once, also those without turns, which end in the root. Of a node: ``conv_id`` is its
    smallest member, ``n_convs`` counts the members, ``n_children`` and ``n_leaves`` the children and
    the childless nodes of the subtree (itself included), and ``saved`` sums (n_convs - 1) * chars
    over the subtree. No conversations give no nodes.

    Members of hot nodes are counted before they are shuffled; the few nodes that hold more than a
    thousandth of all children are looked up in a broadcast table of at most a thousand rows.
    """
    prepare(turns)
    paths = stored(paths_of(turns, conversations), "trie-paths")
    counted = paths.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"),
    )
    nodes = stored(counted.withColumn("depth", F.col("node.depth")), "trie-nodes")
    children = stored(nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "trie-children")
    nodes = stored(
        nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes",
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(paths, nodes.select("node", "conv_id", "depth", "n_leaves", "saved"), ["n_leaves", "saved"], deepest)
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    placed = join_hot(nodes.drop("n_leaves", "saved"), parents, "parent", "weight")
    return Trie(placed.join(sums.drop("conv_id", "depth"), "node"), paths.filter("length is not null").select("node", "conv_id"))


def list_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of each node's conv_ids, ascending and joined by commas.

    The ids are joined in rows of up to ``LISTED``, and a node's rows are hashed in their order as
    they stream by, so a node may list any number of ids.
    """
    rows = members.groupBy("node", F.floor(F.col("conv_id") / LISTED).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for depth, a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, a, b) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (depth, a, b), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, digest.hexdigest()), schema)], schema=schema)

    flat = rows.repartition("node").sortWithinPartitions("node", "block").select("node.depth", "node.a", "node.b", "ids")
    found = flat.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")
    return found.select(F.struct("depth", "a", "b").cast(NODE).alias("node"), "ends_sha256")
