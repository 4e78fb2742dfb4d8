"""Prefix trie of conversations, its subtrees summed by bands of depth.

A node is a sequence of first turns. Its id is the exclusive or of hashes of its turns with their depths, 128 bits, so
ids are prefix sums. For each node one conversation that starts with it, the one with the least id, gives the path to
the root. Within a band of depths a node adds its values to its ancestors in that band only; what arrives at the tops
of bands is summed over the tree of tops by the same method, and each top's total then goes to its ancestors in the
band above. Rounds grow with the logarithm of the depth, and no node is repeated more often than a band is high.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltrail.llm.common import remainder, ship_code, stored

#: Depths of a band.
BAND = 16
#: Turns that a conversation may take over from its group's first one.
MOST_LENT = 5
#: Conversations of a group.
GROUP = 100

_NODE = ["depth", "p1", "p2"]


def _hash(salt: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(salt), *columns)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """`conv_id, place, h1, h2, n_chars`: turns numbered from 1 by turn (null first), ties by hash; texts stay behind.

    Rows are sorted over all tasks and numbered in each; what a conversation has in earlier tasks is then added, so a
    conversation of any length is spread over several tasks. Equal rows are told apart by where they were read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _hash(1, role, text).alias("h1"), _hash(2, text, role).alias("h2"),
        F.char_length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("read_at"),
    )
    order = ["turn", "h1", "h2", "read_at"]
    dealt = stored(narrow.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()))
    in_block = Window.partitionBy("conv_id", "block").orderBy(*order)
    numbered = dealt.withColumn("place", F.row_number().over(in_block).cast("long"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    # Only the first conversation of a block can stand in an earlier one, so there is at most one row for each block.
    before = counts.withColumn("earlier", F.sum("n").over(earlier)).where("earlier > 0").select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "earlier"
    )
    same = (F.col("block") == F.col("_block")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    return numbered.join(F.broadcast(before), same, "left").select(
        "conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("place"), "h1", "h2", "n_chars"
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns `conv_id, depth, h1, h2, n_chars` of the rebuilt conversations, and `conv_id` of all of them, turns or not.

    The first h turns of conversation c - c % 100 (all if it has fewer, none if there is none) stand before what c has
    after its own first h, where h is crc32 of c as text (null: empty), modulo 6.
    """
    turns = stored(ordered_turns(conversations))
    h = remainder("conv_id", MOST_LENT + 1).cast("long")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("conv_id") % GROUP == 0
    firsts = sizes.where(first).select(F.col("conv_id").alias("lender"), F.least("n", F.lit(MOST_LENT)).alias("lends"))
    all_convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lender"))
    convs = stored(
        all_convs.join(firsts, "lender", "left").select("conv_id", "lender", F.least("h", F.coalesce("lends", F.lit(0))).alias("lent"), "h")
    )
    shared = turns.where(first & (F.col("place") <= MOST_LENT)).withColumnRenamed("conv_id", "lender")
    lent = convs.join(shared, "lender").where("place <= lent").select("conv_id", F.col("place").alias("depth"), "h1", "h2", "n_chars")
    own = turns.where(F.col("place") > h).alias("t").join(
        convs.select(F.col("conv_id").alias("_conv"), "lent", "h").alias("c"), F.col("conv_id").eqNullSafe(F.col("_conv"))
    ).select("conv_id", (F.col("lent") + F.col("place") - F.col("h")).alias("depth"), "h1", "h2", "n_chars")
    return lent.unionByName(own), convs.select("conv_id")


def earlier_xor(rows: DataFrame, band: int) -> DataFrame:
    """Adds `e1, e2`: the exclusive or of `x1, x2` of the rows of a conversation with a smaller `idx` (dense, from 0).

    Within bands by a window; the bands' own values by the same method, so no window is longer than a band.
    """
    most = rows.agg(F.max("idx")).first()[0]
    before = Window.partitionBy("conv_id", "band").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    banded = rows.withColumn("band", F.expr(f"idx div {band}"))
    local = banded.withColumns({e: F.coalesce(F.bit_xor(x).over(before), F.lit(0)) for e, x in (("e1", "x1"), ("e2", "x2"))})
    if most is None or most < band:
        return local.drop("band")
    bands = stored(banded.groupBy("conv_id", "band").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")))
    outer = earlier_xor(bands.withColumnRenamed("band", "idx"), band).select(
        F.col("conv_id").alias("_conv"), F.col("idx").alias("_band"), F.col("e1").alias("_e1"), F.col("e2").alias("_e2")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("band") == F.col("_band"))
    joined = local.join(outer, same)
    return joined.select(
        *rows.columns, F.col("e1").bitwiseXOR(F.col("_e1")).alias("e1"), F.col("e2").bitwiseXOR(F.col("_e2")).alias("e2")
    )


def trie_paths(turns: DataFrame, convs: DataFrame, band: int) -> DataFrame:
    """`conv_id, depth, p1, p2, e1, e2, n_chars`: the node of each turn and its parent's hash, and the root for each conversation."""
    salted = turns.select(
        "conv_id", F.col("depth") - 1, "n_chars", _hash(3, F.col("depth"), F.col("h1"), F.col("h2")).alias("x1"), _hash(4, F.col("h2"), F.col("depth"), F.col("h1")).alias("x2")
    ).toDF("conv_id", "idx", "n_chars", "x1", "x2")
    found = earlier_xor(stored(salted), band).select(
        "conv_id", (F.col("idx") + 1).alias("depth"), F.col("e1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("e2").bitwiseXOR(F.col("x2")).alias("p2"), "e1", "e2", "n_chars",
    )
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("depth"), none.alias("p1"), none.alias("p2"), none.alias("e1"), none.alias("e2"), none.alias("n_chars"))
    return found.unionByName(roots)


def _within_bands(values: DataFrame, paths: DataFrame, band: int, sums: list[str]) -> DataFrame:
    """`p1, p2, idx` with `sums` over the values at and below each node in its band.

    `values`: `conv_id, idx` and the columns to sum, one row for a conversation and an idx at most; `paths`: `conv_id, idx,
    p1, p2`. What a conversation adds in a band is summed over its path before it is shuffled.
    """
    slot = F.col("idx")
    level = F.expr(f"idx div {band}").alias("band")
    given = values.groupBy("conv_id", level).agg(F.collect_list(F.struct("idx", *sums)).alias("given"))
    path = paths.groupBy(F.col("conv_id").alias("_conv"), F.expr(f"idx div {band}").alias("_band")).agg(F.collect_list(F.struct("idx", "p1", "p2")).alias("path"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("band") == F.col("_band"))

    def added(name: str) -> Column:
        below = F.filter("given", lambda g: g["idx"] >= F.col("node.idx"))
        return F.aggregate(below, F.lit(0).cast("long"), lambda total, g: total + g[name]).alias(name)

    rows = given.join(path, same).select("given", F.explode("path").alias("node")).select("node.*", *map(added, sums))
    return rows.groupBy("p1", "p2", slot.alias("idx")).agg(*[F.sum(c).alias(c) for c in sums])


def subtree_sums(nodes: DataFrame, paths: DataFrame, band: int, sums: list[str]) -> DataFrame:
    """`p1, p2, idx` with `sums` over each node's subtree, itself included.

    `nodes`: `conv_id, idx, p1, p2` and the columns to sum, where `conv_id` is a conversation through the node, the same
    one for it and any node below on that conversation that has it too; `paths`: `conv_id, idx, p1, p2`.
    """
    local = stored(_within_bands(nodes, paths, band, sums))
    most = nodes.agg(F.max("idx")).first()[0]
    if most is None or most < band:
        return local
    top = F.col("idx") % band == 0
    above = (F.col("idx") / band).cast("long").alias("idx")
    through = nodes.where(top).select("conv_id", "idx", "p1", "p2")
    tops = stored(through.join(local, ["p1", "p2", "idx"]).select("conv_id", above, "p1", "p2", *sums))
    totals = subtree_sums(tops, stored(paths.where(top).select("conv_id", above, "p1", "p2")), band, sums)
    # A completed top stands below the last node of the band above it.
    handed = tops.drop(*sums).join(totals, ["p1", "p2", "idx"]).where("idx > 0").select("conv_id", (F.col("idx") * band - 1).alias("idx"), *sums)
    return local.unionByName(_within_bands(handed, paths, band, sums)).groupBy("p1", "p2", "idx").agg(*[F.sum(c).alias(c) for c in sums])


def _joined_hash(schema: pa.Schema):
    """Rows `p1, p2, depth, ids`, sorted by node and place, to the SHA-256 of the ids of a node with commas between."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != node:
                    if node is not None:
                        out.append([*node, hashed.hexdigest()])
                    node, hashed = now, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [*node, hashed.hexdigest()], strict=True))], schema)

    return work


def ends_hashes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """`depth, p1, p2, ends_sha256`: for nodes where conversations end, the hash of their ids in order, joined by commas.

    Ids are sorted over all tasks and joined within each. Where a node's ids lie in several tasks their pieces, one for
    each, are hashed one after another, as a stream.
    """
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("node")).select("node.*", "conv_id")
    dealt = stored(last.repartitionByRange(*_NODE, "conv_id").withColumn("block", F.spark_partition_id()))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id"))), lambda x: F.coalesce(x["conv_id"].cast("string"), F.lit(""))), ",")
    pieces = stored(dealt.groupBy(*_NODE, "block").agg(text.alias("ids")))
    # A block shares its first and its last node with others at most.
    several = F.broadcast(pieces.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_NODE))
    single = pieces.join(several, _NODE, "left_anti").select(*_NODE, F.sha2("ids", 256).alias("ends_sha256"))
    streamed = pieces.join(several, _NODE).repartition(*_NODE).sortWithinPartitions(*_NODE, "block").select(*_NODE, "ids")
    schema = pa.schema([*[(c, pa.int64()) for c in _NODE], ("ends_sha256", pa.string())])
    joined = ship_code(streamed).mapInArrow(_joined_hash(schema), "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")
    return single.unionByName(joined)


def prefix_trie(turns: DataFrame, convs: DataFrame, band: int = BAND) -> DataFrame:
    """A row for each node: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`.

    `turns`: `conv_id, depth` (dense, from 1), `h1, h2` (hashes of role and text) and `n_chars`; `convs`: every `conv_id`,
    also of conversations without turns. `conv_id` is the smallest of a node's conversations (`n_convs`), `n_leaves` are
    nodes without children in its subtree, `saved_tokens` sums (n_convs - 1) * n_chars over it, `ends_sha256` hashes the
    ids of conversations that end there, in order and with commas between (none: the empty text). The root has depth 0
    and no parent.

    A null id is one conversation, smaller than others among the ends and larger elsewhere; a node with that conversation
    only has a null `conv_id`. No conversations give no rows.
    """
    paths = stored(trie_paths(turns, convs, band))
    nodes = stored(
        paths.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.any_value("e1").alias("e1"), F.any_value("e2").alias("e2"), F.any_value("n_chars").alias("n_chars")
        )
    )
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("e1").alias("p1"), F.col("e2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = stored(nodes.join(below, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    values = counted.select(
        "conv_id", F.col("depth").alias("idx"), "p1", "p2", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"),
    )
    totals = subtree_sums(stored(values), paths.select("conv_id", F.col("depth").alias("idx"), "p1", "p2"), band, ["n_leaves", "saved_tokens"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), F.col("conv_id").alias("parent_conv_id"))
    named = counted.join(parents, ["depth", "e1", "e2"], "left")
    return (
        named.join(totals.withColumnRenamed("idx", "depth"), _NODE)
        .join(ends_hashes(paths, convs), _NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
