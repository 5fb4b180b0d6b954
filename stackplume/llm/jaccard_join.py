"""N-gram Jaccard join: near-copies by a partition of the token universe, with one-deletion neighbourhoods.

Sets that are alike by t differ in at most H = (1 - t) / (1 + t) * (sum of their sizes) tokens.  The hashed universe of
tokens is cut into segments, in a way of its own for each band of set sizes; a set meets those of its band and of the
band below.  A pair that may differ in H tokens has equal subsets in all but H of the m segments of the smaller one's
band, and m is more than H + SPARE.  That alone ends most sets: their subsets are found nowhere else.

For the rest the budget is allocated by cost.  A set may skip a segment (worth 0), look up its subset there (worth 1) or
look up its subset and everything one deletion away (worth 2); any allocation worth H + 1 finds every partner.  A set
whose shared subsets are rare looks all of them up, which also counts in how many segments a partner agrees; one with
frequent subsets takes the cheapest allocation.  Neighbourhoods cost a row for each token of every set of the band, so
they are indexed in the bands where they save much more than that; where a few sets cannot do without, for want of tokens
in some segments, only the segments they ask for are indexed.  What look-ups meet, by neighbourhoods too, is dropped
at once where sketches of the sets differ in more bits than the sets may differ in tokens.  Candidates are compared exactly.

Links are wanted as connected components, so sets that are already connected are never compared: subsets are first
compared with their neighbours and the most typical set of each subset, which connects large groups of near-copies with few comparisons, and
only subsets shared by several components remain for the allocation.  Nothing is capped on the way.

Tokens are 64-bit hashes of word n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import Store
from stackplume.operators.clustering import connected_components

SHINGLE = 4
#: Least similarity in hundredths.
PERCENT = 85
#: Segments beyond those that the differences may touch.
SPARE = 2
#: Sizes of a band lie within this ratio, in halves.
BAND_RATIO = 3
#: Most rounds in which sets are compared with their neighbours in a shuffled order, and comparisons of a set in each.
#: Rounds end when one adds less than a tenth to the links or leaves more than a third of the rows.
ROUNDS = 3
NEIGHBOURS = 2
#: Bits of the parities that are compared before whole sets are.
PARITY_BITS = 1024
#: Bits of the parities that travel with look-ups, a divisor of ``PARITY_BITS``.
SKETCH_BITS = 256
#: Sets of more tokens may differ in so many that folded parities tell little; their whole parities travel too.
FOLDED_UP_TO = 512
#: Met rows that cost as much as one row of a neighbourhood, which is shuffled and stored several times; a met row is
#: dropped in the join unless the sketches are near.
NEAR_ROW = 16
#: Bits of the map of sets whose texts are wanted again, sent to all tasks; a multiple of 64.
BITMAP = 1 << 22
#: Links that are contracted together within a task.
STARRED = 1 << 18
#: Where less than one of so many nodes of a band cannot do with whole subsets, only the segments they lack are indexed.
FEW = 10
#: A set with more rows to look up than this share of its tokens asks for neighbourhoods.
DEAR = 1.0

_random = np.random.Generator(np.random.PCG64(12))
_places = _random.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)
_OF_SEGMENT, _OF_BAND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _stirred(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a text of fewer words is one run, no words give none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    runs = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        runs += hashes[k : k + len(runs)] * _places[k]
    return np.unique(_stirred(runs))


def band_bounds(largest: int) -> list[int]:
    """Least sizes of the bands, up to the first beyond ``largest``."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * BAND_RATIO // 2))
    return bounds


_BOUNDS = np.array(band_bounds(1 << 40), np.int64)


def band_of(size: int) -> int:
    return int(np.searchsorted(_BOUNDS, size, "right")) - 1


def may_differ(total: int, percent: int = PERCENT) -> int:
    """In how many tokens two sets of so many tokens together may differ."""
    return (100 - percent) * total // (100 + percent)


def budget_in(size: int, band: int, percent: int = PERCENT) -> int:
    """In how many tokens a set may differ from its largest partner in a band's partition; 0 if it has no partner.

    A partner of less than two tokens' difference is the set itself, and equal sets are one.
    """
    top = int(_BOUNDS[band + 1]) - 1
    own = band_of(size) == band
    if not own and percent * size > 100 * top:
        return 0
    return may_differ(size + (100 * size // percent if own else top), percent)


def segments_of(band: int, percent: int = PERCENT) -> int:
    """Segments of a band's partition, for its largest sets and those of the band above that reach into it."""
    top = int(_BOUNDS[band + 1]) - 1
    return may_differ(top + 100 * top // percent, percent) + 1 + SPARE


def subset_hashes(tokens: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """Sums, sizes and hashes of the subsets in all segments of a band's partition, and the segment of every token."""
    count = segments_of(band, percent)
    segment = ((tokens >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    low = np.bincount(segment, (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), count).astype(np.uint64)
    high = np.bincount(segment, (tokens >> np.uint64(32)).astype(np.float64), count).astype(np.uint64)
    sums = (high << np.uint64(32)) + low
    return sums, np.bincount(segment, minlength=count), _named(sums, np.arange(count), band), segment


def _named(sums: np.ndarray, segments: np.ndarray, band: int) -> np.ndarray:
    of_band = np.uint64(band * int(_OF_BAND) & 0xFFFFFFFFFFFFFFFF)
    return _stirred(_stirred(sums) + segments.astype(np.uint64) * _OF_SEGMENT + of_band).view(np.int64)


#: A set in one of its partitions: ``own`` is that of its own band, the other that of the band below.
NODE = ["node", "vertex", "n", "band", "own", "segments", "empty", "budget"]
_NODE_SCHEMA = "node long, vertex long, n long, band long, own boolean, segments long, empty long, budget long"


def measured(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text, n, digest of the set, and its partitions: band, own, segments, empty, budget and subset hashes."""
    kind = pa.list_(pa.struct([
        ("band", pa.int64()), ("own", pa.bool_()), ("segments", pa.int64()), ("empty", pa.int64()), ("budget", pa.int64()), ("subsets", pa.list_(pa.int64())),
    ]))

    def partitions(tokens: np.ndarray) -> list[dict]:
        own, out = band_of(len(tokens)), []
        for band in (own, own - 1):
            budget = budget_in(len(tokens), band, percent) if band >= 0 else 0
            if budget:
                _, sizes, hashes, _ = subset_hashes(tokens, band, percent)
                filled = hashes[sizes > 0]
                out.append({"band": band, "own": band == own, "segments": len(sizes), "empty": len(sizes) - len(filled), "budget": budget, "subsets": filled})
        return out

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            count, digest, parts = [], [], []
            for text in rows.column(1).to_pylist():
                tokens = shingles(text, size)
                count.append(len(tokens))
                digest.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                parts.append(partitions(tokens) if len(tokens) else [])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(parts, kind)],
                ["doc_id", "text", "n", "digest", "parts"],
            )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        computed, "doc_id long, text string, n long, digest binary, "
        "parts array<struct<band: long, own: boolean, segments: long, empty: long, budget: long, subsets: array<long>>>"
    )


def _held_in_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of sorted (subset, node) whose subset is not alone; the first and last rows of a range may be alone."""
    held = None
    begun = False
    for rows in batches:
        if not rows.num_rows:
            continue
        here = pa.Table.from_batches([held, rows] if held is not None else [rows]).combine_chunks().to_batches()[0]
        subsets, nodes = (here.column(c).to_numpy() for c in (0, 1))
        # Copies of a set are one node.
        new = np.concatenate([[True], (subsets[1:] != subsets[:-1]) | (nodes[1:] != nodes[:-1])])
        if not new.all():
            here = here.filter(pa.array(new, pa.bool_()))
            subsets = here.column(0).to_numpy()
        equal = subsets[1:] == subsets[:-1]
        keep = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        if not begun:
            keep[0] = True
        elif held is not None and was_equal:
            keep[0] = True
        # The last row waits for what follows it.
        begun, was_equal = True, bool(equal[-1]) if len(equal) else (held is not None and was_equal)
        yield here.slice(0, here.num_rows - 1).filter(pa.array(keep[:-1], pa.bool_()))
        held = here.slice(here.num_rows - 1)
    if held is not None:
        yield held


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one subset and different components: consecutive rows, and every row with the first of its subset.

    Rows are sorted by subset and place; a subset that is dealt to two tasks has a first row in each.
    """
    held, first = None, None
    for rows in batches:
        if not rows.num_rows:
            continue
        here = pa.Table.from_batches([held, rows] if held is not None else [rows])
        subset, vertex, n, component = (here[c].to_numpy() for c in ("subset", "vertex", "n", "component"))
        begins = np.concatenate([[True], subset[1:] != subset[:-1]])
        start = np.maximum.accumulate(np.where(begins, np.arange(len(subset)), 0))
        heads = np.stack([vertex[start], n[start], component[start]])
        if first is not None:
            heads[:, start == 0] = first[:, None]
        pair = np.nonzero(~begins[1:] & (component[1:] != component[:-1]))[0]
        # The row after the first stands beside it; the held row was led before.
        led = 1 + np.nonzero(~begins[1:] & (heads[2][1:] != component[1:]) & (heads[0][1:] != vertex[:-1]))[0]
        one, other = np.concatenate([vertex[pair], heads[0][led]]), np.concatenate([vertex[pair + 1], vertex[led]])
        n_one, n_other = np.concatenate([n[pair], heads[1][led]]), np.concatenate([n[pair + 1], n[led]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, other, n_one, n_other)], ["x", "y", "n_x", "n_y"])
        held, first = rows.slice(rows.num_rows - 1), heads[:, -1]


def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect the same vertices as the given ones: every vertex with its root, for ``most`` edges at a time."""
    parent: dict[int, int] = {}
    edges = 0

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], ["a", "b"])

    for rows in batches:
        for a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if edges == most:
                yield found()
                parent, edges = {}, 0
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
            edges += 1
    yield found()


#: A node that may have a partner: it agrees in all but ``budget`` segments.
OPEN = "shared + empty >= segments - budget"


class Join:
    """The join of a set of distinct token sets with itself, up to connected components."""

    def __init__(self, store: Store, percent: int):
        self.store, self.percent = store, percent
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.linked = 0
        self.known: DataFrame | None = None

    def large_enough(self, n: str, m: str):
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def may_be_alike(self, one: str, other: str, n: str, m: str, bits: int = PARITY_BITS):
        """Whether parities of two sets of n and m tokens differ in no more bits than the sets may differ in tokens."""
        differing = sum((F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(bits // 64)), F.lit(0))
        return differing * (100 + self.percent) <= (F.col(n) + F.col(m)) * (100 - self.percent)

    def sketches_near(self):
        """``may_be_alike`` by what travels with look-ups: folded parities, and whole ones where both sets have them."""
        folded = self.may_be_alike("sketch", "sketch_y", "n", "n_y", SKETCH_BITS)
        return folded & F.coalesce(self.may_be_alike("whole", "whole_y", "n", "n_y"), F.lit(True))

    def components(self) -> DataFrame:
        """vertex and component of all linked vertices, found again only when links were added."""
        if self.known is None:
            # A task contracts so many links that its memory is bounded; when all are that few, these are the components.
            stars = self.links.coalesce(1 + self.linked // STARRED).mapInArrow(partial(_stars, most=STARRED), "a long, b long")
            found = connected_components(stars) if self.linked >= STARRED else stars.toDF("vertex", "component")
            self.known = self.store.keep(found, f"components-{self.linked}")
        return self.known

    def compare(self, pairs: DataFrame, sets: DataFrame, name: str) -> bool:
        """Add the pairs (a, b) that are alike to the links; true if they are a tenth of all links or more."""
        pairs = self.store.keep(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"), f"pairs-{name}")
        # Tokens that differ flip a bit of a set's parities each or cancel out, so parities never differ in more bits.
        a, b = (sets.select(F.col("vertex").alias(side), F.size("tokens").alias(f"n_{side}"), F.col("parities").alias(f"p_{side}")) for side in "ab")
        near = pairs.join(a, "a").join(b, "b").where(self.may_be_alike("p_a", "p_b", "n_a", "n_b"))
        near = self.store.keep(near.select("a", "b"), f"near-{name}")
        # Only the sets of these pairs are dealt out, two to a pair.
        sides = near.select("a", "b", F.explode(F.array("a", "b")).alias("vertex")).join(sets.select("vertex", "tokens"), "vertex")
        both = sides.groupBy("a", "b").agg(F.min_by("tokens", "vertex").alias("one"), F.max_by("tokens", "vertex").alias("other"))
        common = F.size(F.array_intersect("one", "other"))
        either = F.size("one") + F.size("other") - common
        alike = both.where(common * 100 >= either * self.percent).select("a", "b")
        found = self.store.keep(alike, f"links-{name}")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        added = found.count()
        self.linked += added
        self.known = None if added else self.known
        return added * 10 >= self.linked > 0

    def open_rows(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows (subset and the columns of NODE) of nodes that may have a partner in another component, with their
        component and the number of their ``unshared`` segments.

        Such a pair has equal subsets in all but ``budget`` segments, empty ones included, so both nodes have as many
        segments that are empty or shared by several components.
        """
        placed = self.store.keep(self.placed(rows), f"placed-{name}")
        several = self.store.keep(
            placed.groupBy("subset").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("subset"),
            f"several-{name}",
        )
        contested = self.store.keep(placed.join(several, "subset", "left_semi"), f"contested-{name}")
        unsettled = self.store.keep(
            contested.groupBy("node").agg(F.count(F.lit(1)).alias("shared"), *(F.max(c).alias(c) for c in ("segments", "empty", "budget"))).where(OPEN)
            .select("node", F.expr("segments - empty - shared").alias("unshared")),
            f"unsettled-{name}",
        )
        return self.store.keep(contested.join(unsettled, "node"), f"open-{name}")

    def compare_neighbours(self, rows: DataFrame, sets: DataFrame, turn: int) -> bool:
        """Compare every vertex with those that most often stand beside it or first in a subset; see ``compare``.

        Sets that share most of their segments come first, as they are likest to the others; equals are shuffled.
        """
        order = ["subset", "unshared", "place"]
        placed = rows.withColumn("place", F.xxhash64(F.lit(turn), "vertex")).repartitionByRange(*order).sortWithinPartitions(*order)
        beside = placed.select("subset", "vertex", "n", "component").mapInArrow(_neighbours, "x long, y long, n_x long, n_y long")
        counted = (
            beside.where(self.large_enough("n_x", "n_y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
        )
        both = counted.withColumn("of", F.explode(F.array("a", "b")))
        # The pairs of one vertex; a vertex that is first in many subsets has many, but none that is compared twice.
        best = both.groupBy("of").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "a", "b")), asc=False), 1, NEIGHBOURS).alias("best"))
        return self.compare(best.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct(), sets, f"turn{turn}")

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their vertex."""
        if self.links is None:
            return rows.withColumn("component", F.col("vertex"))
        return rows.join(self.components(), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))

    def compare_allocated(self, rows: DataFrame, bare: DataFrame, sets: DataFrame) -> None:
        """Find all partners in other components of the nodes of ``rows`` by allocated look-ups, and compare them.

        ``bare`` nodes may agree with a partner in empty segments only, so they need no row.
        """
        # What a look-up meets: sets of other components in the band of the smaller one.
        here = self.store.keep(rows.where("own").groupBy("subset", "component").agg(F.count(F.lit(1)).alias("here")), "met-here")
        everywhere = self.store.keep(here.groupBy("subset").agg(F.sum("here").alias("everywhere")), "met")
        met = rows.join(everywhere, "subset").join(here, ["subset", "component"], "left").withColumn(
            "met", F.col("everywhere") - F.coalesce("here", F.lit(0))
        )
        listed = met.groupBy(*NODE, "component").agg(F.sort_array(F.collect_list(F.struct("met", "subset"))).alias("costs"))
        alone = self.placed(bare.join(rows.select("node").distinct(), "node", "left_anti"))
        listed = listed.unionByName(alone.select(*NODE, "component", F.array().cast("array<struct<met: long, subset: long>>").alias("costs")))
        plans = self.store.keep(_planned(listed, self.percent), "plans")
        near_bands = self.store.keep(neighbourhood_bands(plans), "near-bands")
        near = near_bands.where("NOT few").select("band")
        plain = plans.join(near.withColumn("dear", F.lit(True)), ["band", "dear"], "left_anti")
        whole = F.when(F.size("tokens") > FOLDED_UP_TO, F.col("parities"))
        sketches = self.store.keep(sets.select("vertex", sketch("parities").alias("sketch"), whole.alias("whole")), "sketches")
        probes = self.store.keep(
            plain.join(sketches, "vertex").select(*NODE, "component", "all", "sketch", "whole", F.explode("subsets").alias("subset")), "probes"
        )
        index = rows.where("own").join(sketches, "vertex").select(
            "subset", *(F.col(c).alias(f"{c}_y") for c in ("vertex", "n", "empty", "component", "sketch", "whole"))
        )
        # Sets that differ in H tokens agree in all but H segments; empty ones leave no row.
        agree = F.col("segments") - F.floor((F.col("n") + F.col("n_y")) * (100 - self.percent) / (100 + self.percent)) - F.least("empty", "empty_y")
        pairs = (
            probes.join(self.store.keep(index, "index"), "subset").where("component <> component_y").where(self.smaller())
            .where(self.large_enough("n", "n_y")).where(self.sketches_near()).groupBy("vertex", "vertex_y")
            .agg(F.count(F.lit(1)).alias("agreed"), F.min(F.when(F.col("all"), agree).otherwise(1)).alias("needed")).where("agreed >= needed")
        )
        found = pairs.select(
            F.least("vertex", "vertex_y").alias("a"), F.greatest("vertex", "vertex_y").alias("b"), (F.col("agreed") - F.col("needed")).alias("surplus")
        )
        if not near.isEmpty():
            found = found.unionByName(self.near_pairs(plans.join(near, "band"), sets).withColumn("surplus", F.lit(0).cast("bigint")))
        few = near_bands.where("few").select("band")
        if not few.isEmpty():
            found = found.unionByName(self.lacking_pairs(plans.join(few, "band"), sets).withColumn("surplus", F.lit(0).cast("bigint")))
        found = self.store.keep(found.groupBy("a", "b").agg(F.max("surplus").alias("surplus")), "candidates")
        # The likeliest candidates of every set first: what they connect needs no comparison any more.
        found = self.still_apart(found, "first")
        few = sets.count()
        for turn in range(ROUNDS):
            if found.count() <= few:
                break
            best = found.withColumn("of", F.explode(F.array("a", "b"))).groupBy("of").agg(
                *(F.max(F.struct("surplus", F.xxhash64(F.lit(k), "a", "b"), "a", "b")).alias(f"best{k}") for k in range(NEIGHBOURS))
            )
            best = best.select(F.explode(F.array(*(f"best{k}" for k in range(NEIGHBOURS)))).alias("p")).select("p.a", "p.b").distinct()
            more = self.compare(best, sets, f"likeliest{turn}")
            found = self.still_apart(found, f"{turn}")
            if not more:
                break
        self.compare(found.select("a", "b"), sets, "allocated")

    def still_apart(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, surplus) that are neither connected nor compared yet."""
        if self.links is None:
            return pairs
        of = self.components()
        a, b = (of.select(F.col("vertex").alias(side), F.col("component").alias(f"of_{side}")) for side in "ab")
        apart = pairs.join(a, "a", "left").join(b, "b", "left").where(
            F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
        ).select("a", "b", "surplus")
        return self.store.keep(apart.join(self.tested, ["a", "b"], "left_anti"), f"apart-{name}")

    def smaller(self):
        """A node looks up sets of at most its own size, so every pair is met from one side."""
        return (F.col("n") > F.col("n_y")) | ((F.col("n") == F.col("n_y")) & (F.col("vertex") > F.col("vertex_y")))

    def lacking_pairs(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Candidates (a, b) of the few bare nodes among ``nodes``, all of some bands, beyond those that share a subset.

        A bare node's segments with tokens, worth one each, fall short by a few; neighbourhoods of as many segments make up
        for it, so the other sets of the band need rows in these segments only.
        """
        columns = ["node", "vertex", "n", "component", "band", "own", "dear"]
        bare = self.store.keep(nodes.where("bare").select(*columns), "bare-nodes")
        tokens = sets.select("vertex", "tokens", sketch("parities").alias("sketch"))
        asked = bare.join(self.store.keep(_lacking(bare.join(tokens, "vertex"), self.percent), "lacking"), "node")
        # A band has a bounded number of segments, a few of them are asked for.
        of_band = asked.select("band", F.explode("within").alias("segment")).groupBy("band").agg(F.collect_set("segment").alias("within"))
        # Partners are at most as large, and nearly so.
        sizes = asked.select("band", F.explode(F.sequence(F.expr(f"n * {self.percent} div 100"), F.col("n"))).alias("n")).distinct()
        met = self.store.keep(nodes.where("own").select(*columns).join(sizes, ["band", "n"]).join(of_band, "band"), "nodes-met")
        probes = _all_subsets(asked.join(tokens, "vertex"), self.percent).select("subset", "vertex", "n", "component", "sketch", "deleted")
        index = _all_subsets(met.join(tokens, "vertex"), self.percent).select(
            "subset", *(F.col(c).alias(f"{c}_y") for c in ("vertex", "n", "component", "sketch", "deleted"))
        )
        return (
            probes.join(index, "subset").where("component <> component_y AND NOT (deleted AND deleted_y)")
            .where(self.smaller()).where(self.large_enough("n", "n_y")).where(self.may_be_alike("sketch", "sketch_y", "n", "n_y", SKETCH_BITS))
            .select(F.least("vertex", "vertex_y").alias("a"), F.greatest("vertex", "vertex_y").alias("b")).distinct()
        )

    def near_pairs(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Candidates (a, b) of the dear nodes among ``nodes``, all of some bands, by subsets and one-deletion neighbourhoods."""
        nodes = nodes.join(sets.withColumn("sketch", sketch("parities")), "vertex").withColumn("within", F.lit(None).cast("array<long>"))
        looked = self.store.keep(_all_subsets(nodes, self.percent), "subsets")
        here = looked.groupBy("subset", "component").agg(
            F.count_if(F.expr("NOT deleted AND own")).alias("whole"), F.count_if(F.expr("deleted AND own")).alias("less")
        )
        here = self.store.keep(here, "subset-components")
        everywhere = self.store.keep(
            here.groupBy("subset").agg(F.sum("whole").alias("all_whole"), F.sum("less").alias("all_less")).where("all_whole + all_less > 0"),
            "subset-counts",
        )
        # Rows of other components that each look-up would meet; one that meets nothing leaves no row.
        others = {c: F.col(f"all_{c}") - F.coalesce(F.col(c), F.lit(0)) for c in ("whole", "less")}
        cost = (
            looked.where("dear").join(everywhere, "subset").join(here, ["subset", "component"], "left")
            .select(
                "node", "n", "segment", F.when(F.col("deleted"), 0).otherwise(others["whole"]).alias("first"),
                F.when(F.col("deleted"), others["whole"]).otherwise(others["less"]).alias("second"),
            )
            .groupBy("node", "n", "segment").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))
        )
        # The segments of one set.
        listed = cost.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("segment", "first", "second"))).alias("costs"))
        chosen = self.store.keep(_allocated(listed, self.percent), "chosen")
        probes = (
            looked.join(chosen, ["node", "segment"]).where("NOT deleted OR worth = 2")
            .select("subset", "vertex", "n", "component", "sketch", "deleted", "worth")
        )
        index = looked.where("own").select("subset", *(F.col(c).alias(f"{c}_y") for c in ("vertex", "n", "component", "sketch", "deleted")))
        return (
            self.store.keep(probes, "near-probes").join(self.store.keep(index, "near-index"), "subset")
            .where("component <> component_y AND NOT (deleted AND deleted_y) AND (worth = 2 OR NOT deleted_y)")
            .where(self.smaller()).where(self.large_enough("n", "n_y")).where(self.may_be_alike("sketch", "sketch_y", "n", "n_y", SKETCH_BITS))
            .select(F.least("vertex", "vertex_y").alias("a"), F.greatest("vertex", "vertex_y").alias("b")).distinct()
        )


def _planned(nodes: DataFrame, percent: int) -> DataFrame:
    """The look-ups of every node: all of its shared subsets where that costs little more, else the cheapest that do.

    ``nodes``: the columns of NODE, component, and costs, the shared subsets with the rows that each meets, rarest
    first.  Segments that share nothing are worth one each and cost nothing; empty ones count as skipped.  ``dear``
    marks nodes with more rows to meet than ``DEAR`` times their tokens, ``bare`` those for which whole subsets cannot
    be worth enough because too many segments are empty.
    """

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            plain = rows.drop_columns(["costs"])
            chosen, everything, price, dear, bare = [], [], [], [], []
            columns = (plain.column(c).to_pylist() for c in ("n", "band", "segments", "empty"))
            for n, band, segments, empty, costs in zip(*columns, rows.column("costs").to_pylist()):
                top = int(_BOUNDS[band + 1]) - 1
                free = segments - empty - len(costs)
                lacking = max(0, may_differ(n + min(n, top), percent) + 1 - free)
                met = [c["met"] for c in costs]
                least, whole = sum(met[:lacking]), sum(met)
                looks_all = lacking > 0 and whole <= 2 * least + n
                chosen.append([c["subset"] for c in (costs if looks_all else costs[:lacking]) if c["met"]])
                everything.append(looks_all)
                price.append(least)
                bare.append(lacking > len(costs))
                dear.append(least > DEAR * n or lacking > len(costs))
            kinds = [pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [*plain.columns, *(pa.array(c, k) for c, k in zip((chosen, everything, price, dear, bare), kinds))],
                [*plain.schema.names, "subsets", "all", "cost", "dear", "bare"],
            )

    return nodes.mapInArrow(computed, f"{_NODE_SCHEMA}, component long, subsets array<long>, all boolean, cost long, dear boolean, bare boolean")


def neighbourhood_bands(plans: DataFrame) -> DataFrame:
    """The bands in which neighbourhoods save more than they cost, or whole subsets cannot be worth enough for some nodes.

    ``few``: neighbourhoods are wanted for a few such nodes only, in a few segments.
    """
    bands = plans.groupBy("band").agg(
        F.coalesce(F.sum(F.when(F.col("dear"), F.col("cost"))), F.lit(0)).alias("saved"), F.sum(F.when(F.col("own"), F.col("n"))).alias("price"),
        F.count_if("bare").alias("bare"), F.count(F.lit(1)).alias("nodes"),
    )
    saves = F.coalesce(F.col("saved") > NEAR_ROW * F.col("price"), F.lit(False))
    return bands.where(saves | (F.col("bare") > 0)).select("band", (~saves & (F.col("bare") * FEW <= F.col("nodes"))).alias("few"))


def _lacking(nodes: DataFrame, percent: int) -> DataFrame:
    """node and the segments ``within`` which it needs neighbourhoods, or empty subsets, beside all subsets with tokens.

    Those of most tokens come first: their neighbourhoods are the rarest.
    """

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            within = []
            for n, band, tokens in zip(rows.column("n").to_pylist(), rows.column("band").to_pylist(), rows.column("tokens")):
                sizes = subset_hashes(tokens.values.to_numpy().view(np.uint64), band, percent)[1]
                needed = may_differ(n + min(n, int(_BOUNDS[band + 1]) - 1), percent) + 1
                # Filled segments are worth one more each by their neighbourhoods, then empty ones by themselves.
                within.append(np.argsort(-sizes, kind="stable")[: max(0, needed - int((sizes > 0).sum()))])
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(within, pa.list_(pa.int64()))], ["node", "within"])

    return nodes.select("node", "n", "band", "tokens").mapInArrow(computed, "node long, within array<long>")


def _all_subsets(nodes: DataFrame, percent: int) -> DataFrame:
    """Subsets of the segments ``within`` (NULL: all) of every node, empty ones too, and those with one token deleted."""
    numbers = ["node", "vertex", "n", "component"]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            tokens_of = rows.column("tokens")
            for k in range(rows.num_rows):
                tokens = tokens_of[k].values.to_numpy().view(np.uint64)
                band = rows.column("band")[k].as_py()
                sums, _, hashes, segment = subset_hashes(tokens, band, percent)
                left_out = _named(sums[segment] - tokens, segment, band)
                wanted = rows.column("within")[k].as_py()
                wholes = np.arange(len(hashes)) if wanted is None else np.array(wanted, np.int64)
                if wanted is not None:
                    inside = np.isin(segment, wholes)
                    hashes, left_out, segment = hashes[wholes], left_out[inside], segment[inside]
                count = len(hashes) + len(left_out)
                words = rows.column("sketch")[k].values.to_numpy()
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * len(words), pa.int32()), pa.array(np.tile(words, count)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(count, rows.column(c)[k].as_py(), np.int64)) for c in numbers),
                        pa.array(np.concatenate([wholes, segment])), pa.array(np.concatenate([hashes, left_out])),
                        pa.array(np.arange(count) >= len(hashes)), *(pa.array(np.full(count, rows.column(c)[k].as_py())) for c in ("own", "dear")),
                        sketches,
                    ],
                    [*numbers, "segment", "subset", "deleted", "own", "dear", "sketch"],
                )

    return nodes.select(*numbers, "band", "own", "dear", "tokens", "sketch", "within").mapInArrow(
        computed, "node long, vertex long, n long, component long, segment long, subset long, deleted boolean, own boolean, dear boolean, sketch array<long>"
    )


def allocate(first: np.ndarray, second: np.ndarray, needed: int) -> np.ndarray:
    """What every segment is worth (0, 1 or 2) so that all are worth ``needed`` together, the cheapest first.

    ``first``: rows met by looking up the subset; ``second``: rows met in addition by its neighbourhood.  A
    neighbourhood that is cheaper than the subset itself is only bought with it, so both count at their mean price.
    """
    joint = (first + second) / 2
    price = np.concatenate([np.where(second < first, joint, first), np.where(second < first, joint, second)])
    segment = np.tile(np.arange(len(first)), 2)
    taken = np.lexsort([segment, np.repeat([0, 1], len(first)), price])[:needed]
    return np.bincount(segment[taken], minlength=len(first))


def _allocated(nodes: DataFrame, percent: int) -> DataFrame:
    """node, segment and worth of the segments that a node looks up for its partners of at most its own size.

    Segments without costs meet nothing, neither does a node without any.
    """

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for node, n, costs in zip(*(rows.column(c).to_pylist() for c in ("node", "n", "costs"))):
                band = band_of(n) - (node & 1)
                needed = may_differ(n + min(n, int(_BOUNDS[band + 1]) - 1), percent) + 1
                first, second = np.zeros((2, segments_of(band, percent)), np.int64)
                for c in costs:
                    first[c["segment"]], second[c["segment"]] = c["first"], c["second"]
                worth = allocate(first, second, needed)
                segments = np.nonzero(worth)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(segments), node)), pa.array(segments), pa.array(worth[segments].astype(np.int64))],
                    ["node", "segment", "worth"],
                )

    return nodes.mapInArrow(computed, "node long, segment long, worth long")


def _token_sets(texts: DataFrame, size: int) -> DataFrame:
    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = [shingles(t, size) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (sets, map(parities, sets)))],
                ["vertex", "tokens", "parities"],
            )

    return texts.select("vertex", "text").mapInArrow(computed, "vertex long, tokens array<long>, parities array<long>")


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of ``PARITY_BITS`` bits whether an odd number of tokens falls on it, as 64-bit words."""
    odd = np.bincount((tokens % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sketch(column: str):
    """Parities folded to ``SKETCH_BITS`` bits; a token still flips one of them."""
    words = SKETCH_BITS // 64
    folded = []
    for k in range(words):
        word = F.get(column, F.lit(k))
        for j in range(k + words, PARITY_BITS // 64, words):
            word = word.bitwiseXOR(F.get(column, F.lit(j)))
        folded.append(word)
    return F.array(*folded)


def vertex_of(salt: int):
    """A number of 63 bits for a set, equal for its copies; another salt is taken where two sets have the same."""
    return F.shiftright(F.xxhash64("digest", F.lit(salt)), 1)


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the wanted ones: a bitmap of ``BITMAP`` bits at most drops most others before a shuffle."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITMAP))
    words = wanted.groupBy(F.shiftright(slot, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {BITMAP}) % 64 AS int))")).alias("_bits"))
    held = F.expr(f"shiftrightunsigned(_bits, cast(pmod(xxhash64({key}), {BITMAP}) % 64 AS int)) & 1") == 1
    return rows.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(words), "_word").where(held).drop("_word", "_bits")


def linked_sets(documents: DataFrame, classes: DataFrame, store: Store, size: int, percent: int) -> DataFrame:
    """vertex and component of all vertices that are linked to another one.

    ``documents``: vertex, place, text, n and parts, see ``measured``; equal sets have equal vertices.  ``classes``:
    every vertex and the place of one of its rows.
    """
    nodes = documents.select("vertex", "n", F.explode("parts").alias("p")).select(
        F.expr("vertex * 2 + if(p.own, 0, 1)").alias("node"), "vertex", "n", *(f"p.{c}" for c in NODE[3:]), "p.subsets"
    )
    shared = store.keep(
        nodes.select(F.explode("subsets").alias("subset"), "node").repartitionByRange("subset", "node").sortWithinPartitions("subset", "node")
        .mapInArrow(_held_in_common, "subset long, node long"),
        "shared",
    )
    kept = store.keep(
        shared.groupBy("node").agg(F.count(F.lit(1)).alias("shared")).join(nodes.select(*NODE), "node").where(OPEN).select(*NODE).distinct(), "kept"
    )
    join = Join(store, percent)
    rows = join.open_rows(store.keep(shared.join(kept, "node"), "rows"), "first")
    bare = store.keep(nodes.where("empty >= segments - budget").select(*NODE).distinct(), "bare")
    wanted = rows.select("vertex").unionByName(bare.select("vertex")).distinct()
    wanted = store.keep(classes.select("vertex", "place").join(wanted, "vertex", "left_semi"), "wanted")
    sets = store.keep(_token_sets(likely(documents.select("place", "text"), wanted, "place").join(wanted, "place"), size), "sets")
    for turn in range(ROUNDS):
        if rows.isEmpty():
            break
        before = rows.count()
        more = join.compare_neighbours(rows, sets, turn)
        rows = join.open_rows(rows.drop("component", "unshared"), f"{turn}")
        if not more or rows.count() * 3 > before:
            break
    join.compare_allocated(rows, bare, sets)
    return join.components()


def similar_documents(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``.

    Documents are linked when the Jaccard similarity of their sets of word n-grams is at least ``percent`` hundredths;
    component_id is the smallest doc_id reachable by links, itself included.  Texts of fewer words than an n-gram are
    one n-gram; NULL and wordless texts have the empty set and are linked with nothing.  Repeated rows count one by one;
    a NULL doc_id gets a component but never names one; an empty table gives no rows; other columns are ignored.
    """
    store = Store(documents.sparkSession, "jaccard-join")
    rows = store.keep(measured(documents, size, percent).withColumn("place", F.monotonically_increasing_id()), "documents")
    digests = store.keep(rows.where("n > 0").groupBy("digest").agg(F.min("place").alias("place"), F.min("doc_id").alias("lowest")), "classes")
    salt = 0
    while not digests.groupBy(vertex_of(salt).alias("vertex")).count().where("count > 1").isEmpty():
        salt += 1
    classes = digests.withColumn("vertex", vertex_of(salt))
    linked = linked_sets(rows.where("size(parts) > 0").withColumn("vertex", vertex_of(salt)), classes, store, size, percent)
    member = store.keep(
        classes.join(linked, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")), "members"
    )
    lowest = store.keep(member.groupBy("component").agg(F.min("lowest").alias("component_id")), "lowest")
    named = store.keep(member.join(lowest, "component").select("digest", "component_id"), "named")
    return (
        rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
