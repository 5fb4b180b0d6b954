"""Training dataset from readings and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.functions.text import industry_weight, season
from stackplume.operators.aggregates import composite_target, quantile_bins, spike_flag
from stackplume.operators.nearest import nearest_site_join
from stackplume.operators.windows import rolling_means, stratified_split

ROLLING = {"rolling_avg_pm25_7d": 7, "rolling_avg_pm25_30d": 30}


def targeted(readings: DataFrame, sites: DataFrame) -> DataFrame:
    """Nearest site, spike flag, season, wind factor, industry weight and target of every located reading."""
    joined = nearest_site_join(readings.where(F.col("timestamp").isNotNull()), sites, keep_stations=True)
    wind = F.col("wind_direction_factor") if "wind_direction_factor" in readings.columns else F.lit(1.0)
    return composite_target(spike_flag(joined)).withColumns(
        {
            "season": season("timestamp"),
            "wind_direction_factor": wind,
            "industry_risk_weight": industry_weight("industry_type"),
        }
    )


def build_dataset(readings: DataFrame, sites: DataFrame, tie: str = "event_id", seed: int = 42) -> DataFrame:
    """Training rows with rolling means and a stratified split; rows without a target are kept but in no split.

    The statistics (deviation, percentile, bin edges) are taken first, over the few columns they need; the wide rows are
    shuffled only for the split and for the rolling means.
    """
    binned = quantile_bins(targeted(readings, sites), "pollution_impact_score", "target_bin")
    split = stratified_split(binned, "target_bin", [tie], seed).withColumn(
        "split", F.when(F.col("pollution_impact_score").isNotNull(), F.col("split"))
    )
    return rolling_means(split, "factory_id", "timestamp", tie, "pm25", ROLLING)


def monthly_history(dataset: DataFrame, step) -> DataFrame:
    """Monthly mean score and pollutants per factory; ``step`` is the month number counted from January 2020."""
    columns = ["pollution_impact_score", "pm25", "pm10", "co", "no2", "so2", "o3"]
    return (
        dataset.where(F.col("pollution_impact_score").isNotNull())
        .withColumn("_step", step)
        .groupBy("factory_id", "industry_type", "city", "_step")
        .agg(*[F.avg(c).alias(c) for c in columns])
        .withColumns(
            {
                "year": (F.floor(F.col("_step") / 12) + 2020).cast("int"),
                "month": (F.pmod(F.col("_step"), F.lit(12)) + 1).cast("int"),
            }
        )
        .drop("_step")
    )
