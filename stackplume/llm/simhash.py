"""SimHash near-duplicates: fingerprints, and a binary trie joined with itself to link those that differ in few bits.

The trie is cut into parts that fit a task.  Two fingerprints within ``budget`` bits agree on at least one of
``budget + 1`` equal blocks, so one trie is kept per block, with that block's bits on top: its subtries below the block
are the parts, and links of a part are found inside it.  A part that is still too large is split further by walking the
pairs of its nodes one level group down: the halves of a pair carry the bits they differ in as a smaller budget, and
pairs whose budget is spent are pruned.  In a task the remaining node pairs are walked level by level in the same way.

Only distinct fingerprints are joined; copies share one and meet their component again by a plain join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import free_name, materialise
from stackplume.operators.clustering import connected_components

BITS = 64
#: Fingerprints of a part that one task joins at once; larger parts are split by node pairs.
PART_ROWS = 20_000
#: Bits by which a part that is too large is split.
SPLIT_BITS = 3
#: Node pairs with at most so many fingerprint pairs are compared directly.
LEAF_PAIRS = 64
#: Node pairs walked at once in a task.
SLICE_PAIRS = 200_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text as a signed number; 0 without words.

    Bytes lose only A-Z to lower() and are split at ASCII white space only, which is what a word is here.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), "<u8")
    set_bits = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        piece = hashes[start : start + (1 << 16)]
        set_bits += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprints(documents: DataFrame, name: str, shingle: int = 3, text: str = "text") -> DataFrame:
    """All columns of ``documents`` and, in ``name``, the fingerprint of every row's whole text."""
    kept = documents.drop(name)
    at = kept.columns.index(text)

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prints = pa.array([fingerprint(t, shingle) for t in rows.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, prints], [*rows.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(computed, f"{fields}, `{name}` long")


def trie_links(prints: np.ndarray, nodes: np.ndarray, budget: int) -> np.ndarray:
    """Pairs (rows of two columns) of prints at Hamming distance up to ``budget`` within the given pairs of nodes.

    ``prints``: unsigned numbers, sorted and distinct within every node.  ``nodes``: one row for each pair of nodes, the
    first and end positions of the one and of the other; a node paired with itself gives every pair of prints once.
    All node pairs go down the trie together, level by level, and are pruned when they differ in too many bits.  Work
    in progress is cut into slices, so that its size is bounded by the depth of the trie, not by the number of pairs.
    """
    found = [np.zeros((0, 2), np.uint64)]
    stack = [(BITS, np.concatenate([nodes, np.full((len(nodes), 1), budget)], 1).astype(np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > SLICE_PAIRS:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF_PAIRS) | (depth == 0)
        leaves, pairs = pairs[small], pairs[~small]
        sizes = (leaves[:, 1] - leaves[:, 0]) * (leaves[:, 3] - leaves[:, 2])
        row = np.repeat(np.arange(len(leaves)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = (leaves[:, 3] - leaves[:, 2])[row]
        i, j = leaves[row, 0] + within // wide, leaves[row, 2] + within % wide
        near = (np.bitwise_count(prints[i] ^ prints[j]) <= budget) & ((leaves[row, 0] != leaves[row, 2]) | (i < j))
        found.append(np.stack([prints[i[near]], prints[j[near]]], 1))
        if not len(pairs):
            continue
        # The prints of a node agree above this bit and are sorted, so those without it come first.
        ones = np.concatenate([[0], np.cumsum((prints >> np.uint64(depth - 1)) & np.uint64(1), dtype=np.int64)])
        l0, l1, r0, r1, rest = pairs.T
        lm, rm = l1 - (ones[l1] - ones[l0]), r1 - (ones[r1] - ones[r0])
        itself = l0 == r0
        children = np.concatenate([
            np.stack([l0, lm, r0, rm, rest], 1),
            np.stack([lm, l1, rm, r1, rest], 1),
            np.stack([l0, lm, rm, r1, rest - 1], 1),
            np.stack([lm, l1, r0, rm, rest - 1], 1)[~itself],
        ])
        alive = (children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2]) & (children[:, 4] >= 0)
        stack.append((depth - 1, children[alive]))
    return np.concatenate(found)


def _links_of(parts: pa.Table, budget: int, width: int) -> pa.RecordBatch:
    """Links within whole parts, whose rows are sorted by part, side and turned print."""
    prints = parts["turned"].to_numpy().view(np.uint64)
    codes = parts["part"].combine_chunks().dictionary_encode().indices.to_numpy()
    side = parts["side"].to_numpy()
    starts = np.concatenate([[0], np.nonzero(np.diff(codes))[0] + 1]).astype(np.int64)
    ends = np.concatenate([starts[1:], [len(codes)]])
    right = ends - np.add.reduceat(side.astype(np.int64), starts)
    two = right < ends
    nodes = np.stack([starts, right, np.where(two, right, starts), ends], 1)
    own = parts["own"].to_numpy(zero_copy_only=False)[starts]
    block = parts["block"].to_numpy()[starts]
    links = [np.zeros((0, 2), np.int64)]
    for b in np.unique(block):
        found = trie_links(prints, nodes[(block == b) & (two | own)], budget)
        turn = np.uint64(int(b) * width)
        back = (found >> turn) | (found << (np.uint64(BITS) - turn)) if b else found
        links.append(np.sort(back.view(np.int64), axis=1))
    both = np.concatenate(links)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def hamming_links(prints: DataFrame, budget: int = 3, part_rows: int = PART_ROWS, split_bits: int = SPLIT_BITS) -> DataFrame:
    """Links (a, b), a < b, between all distinct values of ``print`` that differ in at most ``budget`` bits."""
    width = BITS // (budget + 1)
    distinct = prints.select("print").where("print IS NOT NULL").distinct()
    # Block i is brought to the top by turning the print left by i block widths.
    turned = F.expr(f"if(block = 0, print, shiftleft(print, block * {width}) | shiftrightunsigned(print, {BITS} - block * {width}))")
    parts = (
        distinct.select("print", F.explode(F.array(*[F.lit(i) for i in range(budget + 1)])).alias("block"))
        .withColumn("turned", turned)
        .select(
            F.concat_ws(":", "block", F.shiftrightunsigned("turned", BITS - width)).alias("part"),
            F.lit(0).alias("side"), "turned", "block", F.lit(budget).alias("budget"), F.lit(True).alias("own"),
        )
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append(batch)
            rows += batch.num_rows
            if rows < part_rows:
                continue
            here = pa.Table.from_batches(waiting)
            last = pc.index(here["part"], here["part"][-1]).as_py()
            if last:
                yield _links_of(here.slice(0, last), budget, width)
                waiting = here.slice(last).to_batches()
                rows -= last
        if waiting:
            yield _links_of(pa.Table.from_batches(waiting), budget, width)

    links = None
    depth = width
    while True:
        parts = materialise(parts)
        large = parts.groupBy("part").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > part_rows)
        last = depth + split_bits > BITS or large.isEmpty()
        ready = parts if last else parts.join(large, "part", "left_anti")
        pairs = (
            ready.repartition("part").sortWithinPartitions("part", "side", "turned")
            .select("part", "side", "turned", "block", "own").mapInArrow(joined, "a long, b long")
        )
        links = pairs if links is None else links.unionByName(pairs)
        if last:
            return links.distinct()
        parts = split_parts(parts.join(large.select("part"), "part", "left_semi"), depth, split_bits)
        depth += split_bits


def split_parts(parts: DataFrame, depth: int, bits: int) -> DataFrame:
    """The pairs of child nodes of every part, ``bits`` levels down, that keep some budget.

    A part joined with itself gives its child nodes joined with themselves and every pair of two of them once; a part
    of two nodes gives all pairs across.  A print goes to one child node, and with it to all pairs of that node.
    """
    codes = 1 << bits
    child = F.expr(f"shiftrightunsigned(turned, {BITS - depth - bits}) & {codes - 1}L")
    other = F.explode(F.sequence(F.lit(0), F.lit(codes - 1)))
    paired = parts.withColumn("_child", child).withColumn("_other", other)
    differing = F.bit_count(F.expr("_child ^ _other"))
    low, high = F.least("_child", "_other"), F.greatest("_child", "_other")
    same = F.col("_child") == F.col("_other")
    # In a self-joined part the smaller node is the left one; otherwise the side decides.
    first = F.when(F.col("own"), low).otherwise(F.when(F.col("side") == 0, F.col("_child")).otherwise(F.col("_other")))
    second = F.when(F.col("own"), high).otherwise(F.when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_child")))
    side = F.when(F.col("own"), (F.col("_child") > F.col("_other")).cast("int")).otherwise(F.col("side"))
    return (
        paired.withColumn("_rest", F.col("budget") - differing)
        .where("_rest >= 0")
        .select(
            F.concat_ws(":", "part", first.cast("string"), second.cast("string")).alias("part"), side.alias("side"),
            "turned", "block", F.col("_rest").cast("int").alias("budget"), (F.col("own") & same).alias("own"),
        )
    )


def near_duplicates(documents: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``documents``.

    ``component_id`` is the smallest doc_id among all rows whose fingerprints are linked, directly or in steps, itself
    included.  NULL and wordless texts have fingerprint zero and are linked like any other; repeated rows count one by
    one; a NULL doc_id gets a component but never names one (NULL if no linked row has an id); an empty table gives no
    rows.  Other columns are ignored.
    """
    return attach_components(materialise(with_fingerprints(documents.select("doc_id", "text"), "print", shingle).drop("text")), budget)


def attach_components(prints: DataFrame, budget: int = 3, keep: list[str] | None = None) -> DataFrame:
    """doc_id, fingerprint and component_id of the rows of ``prints`` (doc_id, print), and the columns in ``keep``.

    ``_component`` names a component by one of its fingerprints.
    """
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("lowest"))
    linked = connected_components(hamming_links(classes, budget))
    member = classes.join(linked.withColumnRenamed("vertex", "print"), "print", "left").withColumn(
        "_component", F.coalesce("component", "print")
    )
    lowest = member.groupBy("_component").agg(F.min("lowest").alias("component_id"))
    named = member.join(lowest, "_component").select(F.col("print").alias("_print"), "component_id", "_component")
    return prints.join(named, F.col("print") == F.col("_print")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", *(keep or [])
    )


def keep_first(documents: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """Exactly one row of every component of near-duplicates, with all columns of ``documents``.

    It is the row with the smallest id, a row with a NULL id only where no other is there, and among rows that repeat
    the id the one that was read first.
    """
    a_print, a_row = free_name(documents, "_print"), free_name(documents, "_row")
    rows = materialise(with_fingerprints(documents, a_print, shingle).withColumn(a_row, F.monotonically_increasing_id()))
    slim = rows.select("doc_id", F.col(a_row).alias("_row"), F.col(a_print).alias("print"))
    named = attach_components(slim, budget, keep=["_component", "_row"])
    first = named.groupBy("_component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row"))["_row"].alias("_row")
    )
    return rows.join(first.select(F.col("_row").alias(a_row)), a_row, "left_semi").select(*documents.columns)
