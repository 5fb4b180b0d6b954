"""Risk scores and control recommendations per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.functions import risk as rk
from stackplume.operators.aggregates import site_impact_view
from stackplume.operators.matching import add_risk, match_first, match_nearest
from stackplume.operators.reports import assemble_reports

SCORE_COLUMNS = [f"{p}_score" for p in ("pm25", "pm10", "so2", "no2", "co", "o3")]


def site_risk_scores(sites: DataFrame, readings: DataFrame, max_km: float = 100.0) -> DataFrame:
    scored = add_risk(match_first(sites, readings, max_km))
    return scored.select(
        "factory_id", "factory_name", "industry_type", "city", *SCORE_COLUMNS, "composite_score", "risk_level",
        "dominant_pollutant",
    )


def scored_sites(sites: DataFrame, readings: DataFrame, max_km: float = 100.0) -> DataFrame:
    return add_risk(match_nearest(sites, readings, max_km))


def recommend(
    sites: DataFrame, readings: DataFrame, generated_at: str, suggestions: DataFrame | None = None, max_km: float = 100.0
) -> DataFrame:
    """Nested reports.  ``suggestions`` (factory_id, categories) adds learned actions to the rule-based ones."""
    scored = scored_sites(sites, readings, max_km)
    if suggestions is None:
        return assemble_reports(scored, generated_at)
    joined = scored.join(suggestions.select("factory_id", "categories"), "factory_id", "left")
    return assemble_reports(joined, generated_at, F.col("categories"))


def ranked_advice(dataset: DataFrame) -> DataFrame:
    """One row per factory with mean target, band and advice text."""
    view = site_impact_view(dataset)
    levelled = view.withColumn("risk_level", rk.risk_band_3("pollution_impact_score"))
    return levelled.withColumn("recommendation", rk.site_advice("risk_level", "industry_type"))
