"""Offset-planting plan per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import trees as tr
from stackplume.functions.aqi import aqi_from_score, score_to_concentration

PLAN_POLLUTANTS = ["pm25", "pm10", "no2", "so2", "co"]


def plan_inputs(sites: DataFrame, reports: DataFrame) -> DataFrame:
    """Site, composite score, dominant pollutant and concentrations derived from the report's scores."""
    slim = reports.select(
        "factory_id", F.col("composite_score").alias("_composite"), F.col("dominant_pollutant").alias("_dominant"),
        "pollution_scores",
    )
    composite = F.when(F.coalesce("_composite", F.lit(0.0)) != 0, F.col("_composite")).otherwise(F.lit(5.0))
    dominant = F.when(F.coalesce("_dominant", F.lit("")) != "", F.col("_dominant")).otherwise(F.lit("pm25"))
    return sites.join(slim, "factory_id", "left").select(
        *sites.columns,
        composite.alias("composite_score"),
        dominant.alias("dominant_pollutant"),
        *[score_to_concentration(F.col(f"pollution_scores.{p}_score"), p).alias(p) for p in C.POLLUTANTS],
    )


def tree_plans(inputs: DataFrame, live: DataFrame | None = None, target: float | None = None) -> DataFrame:
    """Full plan for every input row.

    ``live`` (factory_id, aqi and pollutants, NULL where unknown) overrides the derived values.
    """
    rows = inputs
    if live is not None:
        extra = live.select("factory_id", F.col("aqi").alias("_aqi"), *[F.col(p).alias(f"_{p}") for p in C.POLLUTANTS])
        rows = rows.join(extra, "factory_id", "left").withColumns(
            {p: F.coalesce(f"_{p}", p) for p in C.POLLUTANTS}
        )
        rows = rows.withColumn("current_aqi", F.coalesce(F.col("_aqi"), aqi_from_score("composite_score")))
        rows = rows.drop("_aqi", *[f"_{p}" for p in C.POLLUTANTS])
    else:
        rows = rows.withColumn("current_aqi", aqi_from_score("composite_score"))
    goal = F.lit(float(target)) if target is not None else tr.target_aqi("current_aqi")
    rows = rows.withColumns({"target_aqi": goal, "impact_radius_km": tr.impact_radius_km("composite_score")})
    rows = rows.withColumns(
        {
            "impact_area_km2": tr.impact_area_km2("impact_radius_km"),
            "_scale": F.col("target_aqi") / F.greatest(F.col("current_aqi"), F.lit(1.0)),
        }
    )
    counts = {
        p: tr.trees_for(p, p, F.greatest(F.col(p) * F.col("_scale"), F.lit(0.0)), "impact_area_km2")
        for p in PLAN_POLLUTANTS
    }
    rows = rows.withColumns({f"_{p}_trees": c for p, c in counts.items()})
    rows = rows.withColumn("base_trees", tr.base_trees("dominant_pollutant", {p: F.col(f"_{p}_trees") for p in PLAN_POLLUTANTS}))
    rows = rows.withColumns(
        {f"{tier}_trees": tr.with_buffer("base_trees", tier) for tier in C.TREE_BUFFERS}
        | {f"{p}_trees": F.ceil(f"_{p}_trees") for p in PLAN_POLLUTANTS}
    )
    rows = rows.withColumns(
        {
            "hectares": tr.planting_hectares("recommended_trees"),
            "co2_tons": tr.co2_tons("recommended_trees"),
            "aqi_drop": tr.aqi_drop("recommended_trees", "dominant_pollutant"),
        }
    )
    rows = rows.withColumn("feasibility", tr.feasibility("recommended_trees", "hectares"))
    rows = rows.withColumn("notes", tr.plan_notes())
    return rows.select(
        "factory_id", "city", "current_aqi", F.col("composite_score").alias("current_pollution_score"),
        "dominant_pollutant", *C.POLLUTANTS, "target_aqi",
        "minimum_trees", "recommended_trees", "optimal_trees", "impact_radius_km",
        F.bround("hectares", 4).alias("planting_area_hectares"),
        F.bround("co2_tons", 4).alias("annual_co2_offset_tons"),
        F.bround("aqi_drop", 2).alias("estimated_aqi_reduction"),
        F.lit(C.MATURITY_YEARS).alias("timeline_years"),
        *[f"{p}_trees" for p in PLAN_POLLUTANTS],
        "feasibility", "notes",
    )
