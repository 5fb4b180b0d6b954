"""Prefix trie of conversations, with totals of every subtree rolled up in bands of fixed height.

A node is a distinct sequence of first turns.  Its key is the exclusive-or of one 128-bit hash for each (place, role,
text), so keys of all prefixes are running sums and no turn sees more of its conversation than a band.  A node is
represented by its smallest member, and a representative of a node represents the nodes below it on its own path.

Totals: a node adds its own values to its ancestors of the same band only, found on the path of its representative.
Nodes of one path and band are summed before they are dealt out, which is why the step is a window of at most ``BAND``
rows.  The nodes on top of the bands form a trie of a ``BAND``-th of the height, which is rolled up in the same way;
completed totals of band tops are then added to the band above each.  Rounds grow with the logarithm of the height.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackplume.llm.common import Store

#: Height of a band.
BAND = 32
#: Member ids that travel as one piece of a digest.
PIECE_IDS = 2048

KEY = ["depth", "k1", "k2"]
_PLACE_MASK = (1 << 33) - 1


def numbered_turns(conversations: DataFrame, store: Store) -> DataFrame:
    """conv_id, place (1, 2, ...), digest of role and text, and UTF-8 bytes of the text of every turn, in turn order.

    NULL turns come first; turns of one number are ordered by role, then by digest, so repeated rows stay apart and
    every run agrees.  NULL role or text is empty.  Rows without a conv_id belong to no conversation and are left out.
    Places come from sorted ranges, so a conversation may be of any length.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = ["conv_id", "turn", "role", "digest"]
    placed = store.keep(
        slim.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv_id", "digest", "bytes",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_MASK)).alias("row"),
        ),
        "placed",
    )
    runs = placed.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row for each range that holds turns of a conversation.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("offset"))
    return placed.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("offset")).alias("place"), "digest", "bytes")


def sizes(turns: DataFrame) -> DataFrame:
    """conv_id and number of turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def splice(turns: DataFrame, store: Store, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: (conv_id, length) and (conv_id, place, digest, bytes).

    Conversation c begins with the first h turns of conversation c - c % ``group``, all if there are fewer, and goes on
    with its own after its first h; h is crc32 of c as text, modulo ``most``.  A conversation may end up without turns.
    """
    own = sizes(turns)
    heads = own.select(F.col("conv_id").alias("head"), F.col("length").alias("head_length"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    cut = store.keep(
        own.withColumn("h", h).withColumn("head", F.expr(f"conv_id - conv_id % {group}")).join(heads, "head", "left")
        .withColumn("taken", F.least("h", F.coalesce("head_length", F.lit(0))))
        .select("conv_id", "head", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")),
        "cut",
    )
    first = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "head").join(cut.drop("h", "length"), "head").where("place <= taken")
    rest = turns.join(cut.drop("head", "length"), "conv_id").where("place > h").withColumn("place", F.expr("place - h + taken"))
    columns = ["conv_id", "place", "digest", "bytes"]
    return cut.select("conv_id", "length"), first.select(*columns).unionByName(rest.select(*columns))


def _running(rows: DataFrame, deepest: int) -> DataFrame:
    """``rows`` (conv_id, place, e1, e2, ...) with k1 and k2, the exclusive-ors of e1 and e2 up to each place."""
    rows = rows.withColumn("band", F.expr(f"(place - 1) div {BAND}"))
    window = Window.partitionBy("conv_id", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumns({"k1": F.bit_xor("e1").over(window), "k2": F.bit_xor("e2").over(window)})
    if deepest <= BAND:
        return within.drop("band")
    totals = rows.groupBy("conv_id", (F.col("band") + 1).alias("place")).agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"))
    before = _running(totals, (deepest - 1) // BAND + 1).select("conv_id", F.col("place").alias("band"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    later = within.where("band > 0").join(before, ["conv_id", "band"]).withColumns({"k1": F.expr("k1 ^ b1"), "k2": F.expr("k2 ^ b2")})
    return within.where("band = 0").unionByName(later.drop("b1", "b2")).drop("band")


def prefix_paths(lengths: DataFrame, turns: DataFrame, deepest: int) -> DataFrame:
    """One row for every prefix of every conversation: conv_id, KEY, key of the parent, bytes of the last text, ends."""
    hashed = turns.select(
        "conv_id", "place", "bytes",
        F.xxhash64(F.lit(1), "place", "digest").alias("e1"),
        F.xxhash64(F.lit(2), "digest", "place").alias("e2"),
    )
    below = _running(hashed, deepest).join(lengths, "conv_id").select(
        "conv_id", F.col("place").alias("depth"), "k1", "k2", F.expr("k1 ^ e1").alias("p1"), F.expr("k2 ^ e2").alias("p2"),
        "bytes", (F.col("place") == F.col("length")).cast("bigint").alias("ends"),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = lengths.select(
        "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"),
        zero.alias("bytes"), (F.col("length") == 0).cast("bigint").alias("ends"),
    )
    return root.unionByName(below)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row for every node: conv_id (smallest member), KEY, key of the parent, n_convs, n_ends, leaves, saved."""
    return (
        paths.groupBy(*KEY)
        .agg(
            F.min("conv_id").alias("conv_id"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
            F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends"), F.max("bytes").alias("bytes"),
        )
        .withColumn("leaves", (F.col("n_ends") == F.col("n_convs")).cast("bigint"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
        .drop("bytes")
    )


def _within_bands(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """KEY, leaves and saved of every node, summed over the part of its subtree that lies in its band."""
    zero = F.lit(0).cast("bigint")
    dealt = paths.select("conv_id", *KEY, zero.alias("leaves"), zero.alias("saved"), F.lit(True).alias("path")).unionByName(
        nodes.select("conv_id", *KEY, "leaves", "saved", F.lit(False).alias("path"))
    ).withColumn("band", F.expr(f"depth div {BAND}"))
    below = Window.partitionBy("conv_id", "band").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({"leaves": F.sum("leaves").over(below), "saved": F.sum("saved").over(below)})
    return summed.where("path AND (leaves > 0 OR saved > 0)").groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(paths: DataFrame, nodes: DataFrame, deepest: int, store: Store, level: int = 0) -> DataFrame:
    """KEY, leaves and saved of every node that has any, summed over its whole subtree."""
    within = store.keep(_within_bands(paths, nodes), f"within{level}")
    if deepest < BAND:
        return within
    top = f"depth % {BAND} = 0"
    up = {"depth": F.expr(f"depth div {BAND}")}
    # A top without a leaf in its band still hands on what lies deeper.
    values = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("leaves", "saved")}
    tops = store.keep(
        nodes.where(top).select("conv_id", *KEY).join(within, KEY, "left").withColumns(values | up), f"tops{level}"
    )
    top_paths = paths.where(top).select("conv_id", *KEY).withColumns(up)
    totals = subtree_totals(top_paths, tops, deepest // BAND, store, level + 1)
    # What a completed band top gives to the nodes above it in the next band.
    given = tops.where("depth > 0").select("conv_id", *KEY).join(totals, KEY).select(
        "conv_id", (F.col("depth") - 1).alias("band"), "leaves", "saved"
    )
    across = paths.withColumn("band", F.expr(f"depth div {BAND}")).select("conv_id", "band", *KEY).join(given, ["conv_id", "band"])
    columns = [*KEY, "leaves", "saved"]
    both = within.select(*columns).unionByName(across.select(*columns))
    return store.keep(both.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), f"totals{level}")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows (KEY, conv_id), joined to texts of at most ``PIECE_IDS`` ids of one key."""
    names = [*KEY, "first", "ids"]
    key, ids = None, []
    for rows in batches:
        done = []
        for *this, conv in zip(*(rows.column(c).to_pylist() for c in [*KEY, "conv_id"])):
            if ids and (this != key or len(ids) == PIECE_IDS):
                done.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = this
            ids.append(conv)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _PIECES)
    if ids:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, ids[0], ",".join(map(str, ids)))))], _PIECES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every key's sorted pieces, joined by commas."""
    names = [*KEY, "ends_sha256"]
    key, digest = None, None
    for rows in batches:
        done = []
        for *this, ids in zip(*(rows.column(c).to_pylist() for c in [*KEY, "ids"])):
            if this == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = this, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _DIGESTS)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, digest.hexdigest())))], _DIGESTS)


_LONGS = [(name, pa.int64()) for name in KEY]
_PIECES = pa.schema([*_LONGS, ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([*_LONGS, ("ends_sha256", pa.string())])


def end_digests(paths: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the nodes at which a conversation ends.

    Ids are sorted over all tasks and joined to pieces; one task then reads a node's pieces in order and keeps only the
    state of the digest.
    """
    order = [*KEY, "conv_id"]
    pieces = (
        paths.where("ends = 1").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, ids string")
    )
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        _digests, "depth long, k1 long, k2 long, ends_sha256 string"
    )


def build_trie(lengths: DataFrame, turns: DataFrame, store: Store) -> DataFrame:
    """Every node of the trie of the given conversations.

    ``lengths``: conv_id and length (0 for a conversation without turns), one row for each conversation; ``turns``:
    conv_id, place from 1 on without gaps, digest, bytes.  Returns conv_id (smallest member), depth, parent_conv_id
    (NULL for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  No conversations, no nodes.
    """
    deepest = lengths.agg(F.max("length")).first()[0] or 0
    paths = store.keep(prefix_paths(lengths, turns, deepest), "paths")
    nodes = store.keep(trie_nodes(paths), "nodes")
    totals = subtree_totals(paths, nodes, deepest, store).select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.where("n_ends < n_convs").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.join(totals, KEY).join(children, KEY, "left").join(end_digests(paths), KEY, "left")
        .join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``build_trie`` of the conversations as they are; see ``numbered_turns`` for NULLs, ties and repeated rows."""
    store = Store(conversations.sparkSession, "prefix-trie")
    turns = store.keep(numbered_turns(conversations, store), "turns")
    return build_trie(sizes(turns), turns, store)


def spliced_trie(conversations: DataFrame) -> DataFrame:
    """``build_trie`` of the conversations after ``splice``; see ``numbered_turns`` for NULLs, ties and repeated rows."""
    store = Store(conversations.sparkSession, "prefix-trie")
    lengths, turns = splice(store.keep(numbered_turns(conversations, store), "turns"), store)
    return build_trie(lengths, store.keep(turns, "spliced"), store)
