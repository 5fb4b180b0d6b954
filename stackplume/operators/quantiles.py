"""Exact quantiles that never gather a column, or a hot group, in one task.

A mergeable rank sketch gives a narrow value bracket around each wanted rank.  A second pass counts what lies below the
bracket and keeps only the distinct values inside it, so the final ordered step sees a sliver of the group instead of
all of it.  The answer is exact; a bracket that missed its rank would raise instead of returning a wrong value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], keys: list[str] | None = None, accuracy: int = 10_000
) -> DataFrame:
    """Linear-interpolated quantiles, one row per (keys, column): q0, q1, ... plus ``n`` counted values.

    ``keys`` must not be NULL-sensitive: rows whose key is NULL get no quantile.
    """
    keys = list(keys or [])
    group = [*keys, "column"]
    values = (
        df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(keys, columns, "column", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    margin = 4.0 / accuracy
    edges = []
    for p in probabilities:
        edges += [max(p - margin, 0.0), min(p + margin, 1.0)]
    sketch = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.percentile_approx("value", [float(e) for e in edges], accuracy).alias("edges"),
    )
    # Up to 4 * accuracy values the whole group is a bounded bracket; beyond that the margin spans >= 16 ranks.
    small = F.col("n") <= 4 * accuracy
    brackets = []
    for i, p in enumerate(probabilities):
        low = F.when(small | F.lit(p - margin <= 0), F.col("least")).otherwise(F.col("edges")[2 * i])
        high = F.when(small | F.lit(p + margin >= 1), F.col("most")).otherwise(F.col("edges")[2 * i + 1])
        brackets.append(
            F.struct(
                F.lit(i).alias("i"),
                low.alias("low"),
                high.alias("high"),
                (F.lit(float(p)) * (F.col("n") - 1)).alias("position"),
            )
        )
    sketch = sketch.select(*group, "n", F.array(*brackets).alias("brackets"))

    wanted = values.join(sketch, group).select(
        *group, "n", "value", F.explode(F.filter("brackets", lambda b: F.col("value") <= b["high"])).alias("b")
    )
    counted = (
        wanted.select(
            *group, "n", F.col("b.i").alias("i"), F.col("b.position").alias("position"),
            F.when(F.col("value") >= F.col("b.low"), F.col("value")).alias("value"),
        )
        .groupBy(*group, "n", "i", "position", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    running = Window.partitionBy(*group, "i").orderBy(F.col("value").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("rows").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    below = F.floor("position")
    above = F.ceil("position")
    missed = F.max(F.col("value").isNull() & (F.col("upto") > below))
    picked = ranked.groupBy(*group, "n", "i", "position").agg(
        F.min(F.when(F.col("upto") > below, F.col("value"))).alias("v0"),
        F.min(F.when(F.col("upto") > above, F.col("value"))).alias("v1"),
        (missed | (F.max("upto") <= above)).alias("missed"),
    )
    quantile = F.when(F.col("missed"), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).otherwise(
        F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("position") - F.floor("position"))
    )
    exact = picked.select(*group, "n", "i", quantile.alias("quantile"))
    return exact.groupBy(*group, "n").agg(
        *[F.max(F.when(F.col("i") == i, F.col("quantile"))).alias(f"q{i}") for i in range(len(probabilities))]
    )


def _table_quantiles(df: DataFrame, columns: list[str], p: float, accuracy: int = 10_000) -> DataFrame:
    """One quantile of every column of the whole table, as one row; columns keep their names.

    The same brackets as above, but the rows stay wide: a sketch of all columns in one pass, whose single row becomes
    constants, and a second pass that counts below each bracket and emits only the values inside.
    """
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    margin = 4.0 / accuracy
    edges = [max(p - margin, 0.0), min(p + margin, 1.0)]
    places = range(len(columns))
    row = df.select(*[number[c].alias(f"v{i}") for i, c in enumerate(columns)]).agg(
        *[F.struct(
            F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("least"), F.max(f"v{i}").alias("most"),
            F.percentile_approx(f"v{i}", edges, accuracy).alias("edges"),
        ).alias(f"s{i}") for i in places]
    ).first()
    known = [(i, c, row[f"s{i}"]) for i, c in enumerate(columns) if row[f"s{i}"]["n"]]
    items, positions = [], []
    for i, c, s in known:
        small = s["n"] <= 4 * accuracy
        low = s["least"] if small or p - margin <= 0 else s["edges"][0]
        high = s["most"] if small or p + margin >= 1 else s["edges"][1]
        # Without a value: the row lies below the bracket and is only counted.
        value = F.when(number[c] >= F.lit(low), number[c])
        items.append(F.when(number[c] <= F.lit(high), F.struct(F.lit(i).alias("i"), value.alias("value"))))
        positions.append((i, float(p) * (s["n"] - 1)))
    if not known:
        return df.sparkSession.createDataFrame([(None,) * len(columns)], ", ".join(f"`{c}` double" for c in columns))
    counted = (
        df.select(F.explode(F.array_compact(F.array(*items))).alias("b"))
        .groupBy(F.col("b.i").alias("i"), F.col("b.value").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    )
    running = Window.partitionBy("i").orderBy(F.col("value").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("rows").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    out = {}
    for i, position in positions:
        mine, below, above = F.col("i") == i, math.floor(position), math.ceil(position)
        v0 = F.min(F.when(mine & (F.col("upto") > below), F.col("value")))
        v1 = F.min(F.when(mine & (F.col("upto") > above), F.col("value")))
        missed = F.max(mine & F.col("value").isNull() & (F.col("upto") > below)) | (F.max(F.when(mine, F.col("upto"))) <= above)
        out[i] = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).otherwise(
            v0 + (v1 - v0) * F.lit(position - below)
        )
    return ranked.agg(*[out.get(i, F.lit(None).cast("double")).alias(columns[i]) for i in places])


def exact_medians(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Median of each column, one row per key (one row in all without keys), columns keep their names."""
    keys = list(keys or [])
    if not keys:
        return _table_quantiles(df, columns, 0.5)
    medians = exact_quantiles(df, columns, [0.5], keys)
    picks = [F.max(F.when(F.col("column") == c, F.col("q0"))).alias(c) for c in columns]
    return medians.groupBy(*keys).agg(*picks)
