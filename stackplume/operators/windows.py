"""Ordered operators that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackplume.session import ensure_checkpoint_dir


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """First row of every key in an explicit order.

    ``row_number() = 1`` is planned with a per-partition group limit before the shuffle, so a key with very many
    duplicates sends at most one row per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def rolling_means(
    df: DataFrame, key: str, time: str, tie: str, value: str, sizes: dict[str, int], bucket: str = "DAY"
) -> DataFrame:
    """Mean over the current and the preceding rows of the key, NULLs skipped.

    ``sizes`` maps an output column to its number of rows.  The rows of a key are cut into time buckets that are
    windowed independently; each bucket is given the last rows of the buckets before it as a halo, so a single busy
    key is spread over as many tasks as it has buckets and the result equals the undivided window.
    """
    halo_rows = max(sizes.values()) - 1
    bucketed = df.withColumn("_bucket", F.date_trunc(bucket, F.col(time)))
    newest_first = Window.partitionBy(key, "_bucket").orderBy(F.col(time).desc(), F.col(tie).desc())
    row = F.struct(F.col(time).alias("t"), F.col(tie).alias("k"), F.col(value).alias("v"))
    tails = (
        bucketed.select(key, "_bucket", time, tie, value, F.row_number().over(newest_first).alias("_rank"))
        .where(F.col("_rank") <= halo_rows)
        .groupBy(key, "_bucket")
        .agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    )
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(-halo_rows, -1)
    before = F.flatten(F.collect_list("_tail").over(earlier))
    halo = (
        tails.select(key, "_bucket", before.alias("_before"))
        .select(
            key, "_bucket",
            F.explode(
                F.slice("_before", F.greatest(F.size("_before") - halo_rows + 1, F.lit(1)), F.lit(halo_rows))
            ).alias("_row"),
        )
        .select(
            key, "_bucket", F.col("_row.t").alias(time), F.col("_row.k").alias(tie), F.col("_row.v").alias(value),
            F.lit(True).alias("_halo"),
        )
    )
    ordered = Window.partitionBy(key, "_bucket").orderBy(time, tie)
    means = {name: F.avg(value).over(ordered.rowsBetween(1 - n, 0)) for name, n in sizes.items()}
    return (
        bucketed.withColumn("_halo", F.lit(False))
        .unionByName(halo, allowMissingColumns=True)
        .withColumns(means)
        .where(~F.col("_halo"))
        .drop("_halo", "_bucket")
    )


def sample_order(seed: int, *ids) -> "F.Column":
    """A fixed pseudo-random order of the rows: a digest of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def deterministic_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows picked by digest order: the same rows on every run and cluster.

    A limit alone would send up to ``n`` rows of every partition to one task.  The sizes of 65 536 digest slices tell
    where the first ``n`` rows end, and only rows up to that slice are ordered.
    """
    drawn = df.withColumn("_draw", sample_order(seed, *ids)).withColumn("_slice", F.substring("_draw", 1, 4))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = drawn.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    last = before.where(F.col("_before") < n).agg(F.max("_slice").alias("last")).scalar()
    return drawn.where(F.col("_slice") <= last).orderBy("_draw", *ids).limit(n).drop("_draw", "_slice")


def hashed_ranks(df: DataFrame, stratum: str, ids: list[str], seed: int) -> DataFrame:
    """Adds ``draw_rank`` (1..n) and ``draw_size`` (n): position of a row in the digest order of its stratum.

    A stratum can hold most of the table, so it is not ordered in one task: the leading four hex digits cut it into
    65 536 even slices, slice sizes give the offsets, and only slices are ordered.
    """
    drawn = df.withColumn("_draw", sample_order(seed, *ids)).withColumn("_slice", F.substring("_draw", 1, 4))
    sizes = drawn.groupBy(stratum, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    by_stratum = Window.partitionBy(stratum)
    offsets = sizes.select(
        stratum, "_slice",
        F.coalesce(
            F.sum("_rows").over(by_stratum.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_rows").over(by_stratum).alias("draw_size"),
    )
    within = Window.partitionBy(stratum, "_slice").orderBy("_draw", *ids)
    renamed = offsets.withColumnsRenamed({stratum: "_stratum", "_slice": "_slice_2"})
    same = F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_slice") == F.col("_slice_2"))
    return (
        drawn.withColumn("_position", F.row_number().over(within))
        .join(renamed, same)
        .withColumn("draw_rank", F.col("_offset") + F.col("_position"))
        .select(*df.columns, "draw_rank", "draw_size")
    )


def stratified_split(
    df: DataFrame, stratum: str, ids: list[str], seed: int = 42, test: float = 0.15, validation: float = 0.15
) -> DataFrame:
    """Adds ``split`` (train/val/test) with the requested shares inside every stratum."""
    share = (F.col("draw_rank") - 1) / F.col("draw_size")
    split = F.when(share < test, F.lit("test")).when(share < test + validation, F.lit("val")).otherwise(F.lit("train"))
    return hashed_ranks(df, stratum, ids, seed).withColumn("split", split).drop("draw_rank", "draw_size")


def lag_features(df: DataFrame, key: str, order: list[str], score: str, past_only: bool = False) -> DataFrame:
    """Lag 1, lag 3 and trailing 3-row mean of a monthly score (a key has at most twelve rows a year).

    With ``past_only`` the mean covers the three rows before the current one, so that it cannot leak the score itself.
    """
    ordered = Window.partitionBy(key).orderBy(*order)
    trailing = F.avg(score).over(ordered.rowsBetween(-3, -1) if past_only else ordered.rowsBetween(-2, 0))
    return df.withColumns(
        {
            "score_lag_1": F.coalesce(F.lag(score, 1).over(ordered), F.col(score)),
            "score_lag_3": F.coalesce(F.lag(score, 3).over(ordered), F.col(score)),
            "score_rolling_mean_3": F.coalesce(trailing, F.col(score)),
        }
    )


def number_in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """All rows with their place in a total order, from 1: ranges are sorted side by side and offset by their sizes."""
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
        .checkpoint()
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_part").withColumn(name, (F.col("_offset") + F.col("_place") + 1).cast("bigint"))
        .drop("_part", "_place", "_offset")
    )
