"""Mixing sources to target weights by fitting the remaining budget of each source as a subset sum.

Documents are counted by exact length.  Each source gets a target, and every length first gives its proportional share
of it; the long ones then close the gap until it fits into the table of a bounded knapsack, and the knapsack finds the
counts per length whose sum comes nearest to what is left.  Which documents of a length are taken, or taken once more
than the others, is decided by a seeded hash.

Only (source, length) counts meet in one place; documents of one length are ranked within hash slices, so a length or a
source that holds most rows is spread over many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackplume.llm.common import WORD, materialise, whole_text

#: Budgets up to this many words are solved exactly by the knapsack.
KNAPSACK_WORDS = 1 << 16
#: Bits of the seeded hash that cut the documents of one length into slices.
SLICE_BITS = 10


def document_sizes(documents: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, size and the seeded order of every document; NULL text has size 0."""
    identity = F.coalesce(F.xxhash64("doc_id"), F.xxhash64("text"))
    return documents.select(
        "doc_id",
        "source",
        F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(identity)).alias("_order"),
    )


def source_targets(
    counted: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight, no target above ``limit`` times its source.

    ``counted`` has source, size, n.  Sources in code point order, NULL last, take the weights in turn.  What a source
    cannot take is dealt again among the others, which comes to target = min(limit * size, level * weight) for the one
    level that spends the budget.
    """
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("_cap", F.col("source_size") * limit)
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_spent", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_budget", F.sum("source_size").over(everything) * share)
        .withColumn("_level", (F.col("_budget") - F.col("_spent")) / F.col("_weights_left"))
        .withColumn("_common", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(everything))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_common") * F.col("_weight"), F.col("_cap")))
    return filled.select("source", F.col("source_size").cast("bigint").alias("source_size"), target.alias("target"))


def fit_budget(sizes: list[int], counts: list[int], budget: int, table_words: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each size to take so that their words come nearest to ``budget`` from below.

    Every size first gives its proportional share.  If the knapsack cannot close the gap that this leaves, it is tried
    again with half the shares and with none, and the nearest result counts.  Sizes are positive.
    """
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget <= 0 or total == 0:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    longest_first = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best, least = [0] * len(sizes), budget
    for divisor in (1, 2, None):
        taken = [n * budget // (total * divisor) if divisor else 0 for n in counts]
        gap = budget - sum(s * t for s, t in zip(sizes, taken))
        for i in longest_first:
            if gap <= table_words:
                break
            more = min(counts[i] - taken[i], (gap - table_words) // sizes[i] + 1, gap // sizes[i])
            taken[i] += more
            gap -= more * sizes[i]
        for i, more in bounded_knapsack([(i, sizes[i], counts[i] - taken[i]) for i in longest_first], gap).items():
            taken[i] += more
            gap -= more * sizes[i]
        if gap < least:
            best, least = taken, gap
        if least == 0:
            break
    return best


def bounded_knapsack(items: list[tuple[int, int, int]], budget: int) -> dict[int, int]:
    """Counts per item whose summed sizes are the largest reachable sum up to ``budget``.

    ``items``: (key, size, available).  Sums are the bits of one integer, and each item is added in doubling bundles.
    """
    mask = (1 << (budget + 1)) - 1
    reached = 1
    steps: list[tuple[int, int, int, int]] = []
    for key, size, available in items:
        bundle, left = 1, min(available, budget // size)
        while left > 0 and not reached >> budget & 1:
            bundle = min(bundle, left)
            after = (reached | reached << (bundle * size)) & mask
            if after != reached:
                steps.append((key, bundle, bundle * size, reached))
                reached = after
            left -= bundle
            bundle *= 2
    at = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for key, bundle, words, earlier in reversed(steps):
        if not earlier >> at & 1:
            chosen[key] = chosen.get(key, 0) + bundle
            at -= words
    return chosen


def _fit_source(lengths: pd.DataFrame) -> pd.DataFrame:
    """The counts of one source; ``lengths``: one row for each of its distinct lengths.

    A document can be taken ``limit`` times.  ``whole``: copies of every document of a length, ``extra``: how many of
    them are taken once more.
    """
    lengths = lengths.sort_values("size", ignore_index=True)
    sizes, counts = lengths["size"].tolist(), lengths["n"].tolist()
    limit = int(lengths["limit"].iloc[0])
    taken = fit_budget(sizes, [limit * n for n in counts], round(float(lengths["target"].iloc[0])))
    lengths["whole"] = [t // n for t, n in zip(taken, counts)]
    lengths["extra"] = [t % n for t, n in zip(taken, counts)]
    return lengths[["source", "size", "n", "whole", "extra", "source_size", "target"]]


def mix(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``documents``.

    ``taken`` is a multiple of the size, up to ``limit`` times.  NULL sources form one source, NULL and wordless texts have size 0 and
    take nothing, repeated rows count one by one, an empty table gives no rows.  Other columns are ignored.  Repeated
    runs take the same words from the same rows; among rows that are equal in every way either may be the one taken.
    Per source one task sees one row for each distinct length, never the documents.
    """
    slim = materialise(document_sizes(documents, seed))
    counted = slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(counted, weights, share, limit)
    same_source = F.col("c.source").eqNullSafe(F.col("t.source"))
    lengths = (
        counted.alias("c").join(targets.alias("t"), same_source).where("size > 0")
        .select("c.source", "size", "n", "source_size", "target", F.lit(limit).alias("limit"))
    )
    plan = materialise(
        lengths.groupBy("source").applyInPandas(
            _fit_source, "source string, size long, n long, whole long, extra long, source_size long, target double"
        )
    )

    # Only lengths of which some, but not all, documents are taken once more need an order.
    partly = plan.where("extra > 0")
    sliced = slim.withColumn("_slice", F.shiftrightunsigned("_order", 64 - SLICE_BITS))
    per_slice = (
        sliced.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("_rows")).alias("s")
        .join(partly.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")))
        .select("s.source", "s.size", "_slice", "_rows", "extra")
    )
    earlier = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    quota = per_slice.withColumn(
        "_quota", F.greatest(F.lit(0), F.least("_rows", F.col("extra") - F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
    ).select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_slice").alias("_its_slice"), "_rows", "_quota")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(
            quota,
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_slice") == F.col("_its_slice")),
            "left",
        )

    placed = dealt(sliced)
    open_slice = (F.col("_quota") > 0) & (F.col("_quota") < F.col("_rows"))
    in_slice = Window.partitionBy("source", "size", "_slice").orderBy("_order", "doc_id")
    ranked = placed.where(open_slice).withColumn("_extra", (F.row_number().over(in_slice) <= F.col("_quota")).cast("int"))
    settled = placed.where(~F.coalesce(open_slice, F.lit(False))).withColumn(
        "_extra", F.when(F.col("_quota").isNotNull(), (F.col("_quota") > 0).cast("int"))
    )
    chosen = ranked.unionByName(settled).select("doc_id", "source", "size", "_extra")
    per_length = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "whole")
    with_counts = chosen.join(
        per_length,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "left",
    ).drop("_source", "_size")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    return with_counts.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.coalesce("whole", F.lit(0)) + F.coalesce("_extra", F.lit(0)))).cast("bigint").alias("taken"),
    )
