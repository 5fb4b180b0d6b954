"""Filtered and paged views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.functions import risk as rk
from stackplume.operators import listing as ls
from stackplume.operators.aggregates import city_stats, heatmap_metadata
from stackplume.operators.matching import attach_first_recommendation
from stackplume.operators.nearest import radius_search
from stackplume.operators.reports import heatmap_points, reports_to_summary
from stackplume.operators.windows import deterministic_sample


def list_sites(
    sites: DataFrame, recommendations: DataFrame, page: int = 1, page_size: int = 50, city: str | None = None,
    industry: str | None = None, risk_level: str | None = None, centre: tuple[float, float] | None = None,
    radius_km: float = 50.0,
) -> DataFrame:
    """One page of sites with their risk, and the total before paging."""
    kept = ls.filter_contains(ls.filter_contains(sites, city, "city", regex=True), industry, "industry_type", regex=True)
    if centre:
        kept = radius_search(kept, centre[0], centre[1], radius_km, "latitude", "longitude")
    wanted = [
        c for c in ("factory_id", "risk_level", "composite_score", "latest_pm25", "latest_pm10", "dominant_pollutant")
        if c in recommendations.columns
    ]
    joined = attach_first_recommendation(kept, recommendations.select(*wanted), [F.col("composite_score").desc()])
    matching = ls.filter_equal_text(joined, risk_level, "risk_level")
    return ls.with_total(ls.paginate(matching, page, page_size, ["factory_id"]), matching)


def list_readings(
    readings: DataFrame, page: int = 1, page_size: int = 50, city: str | None = None, parameter: str | None = None,
    start: str | None = None, end: str | None = None, centre: tuple[float, float] | None = None, radius_km: float = 50.0,
    order: list | None = None,
) -> DataFrame:
    kept = ls.filter_contains(readings, city, "city", regex=True)
    kept = ls.filter_parameter_present(kept, parameter)
    kept = ls.filter_date_range(kept, start, end)
    if centre:
        kept = radius_search(kept, centre[0], centre[1], radius_km, "station_lat", "station_lon")
    return ls.with_total(ls.paginate(kept, page, page_size, order or ["timestamp", "event_id"]), kept)


def list_reports(
    reports: DataFrame, page: int = 1, page_size: int = 50, risk_level: str | None = None, industry: str | None = None,
    city: str | None = None,
) -> DataFrame:
    kept = ls.filter_equal_text(reports, risk_level, "risk_level")
    kept = ls.filter_contains(ls.filter_contains(kept, industry, "industry_type", regex=True), city, "city", regex=True)
    order = [F.col("composite_score").desc(), F.col("factory_id")]
    return ls.with_total(ls.paginate(reports_to_summary(kept), page, page_size, order), kept)


def recent_city_stats(readings: DataFrame, days: int = 30, as_of: str | None = None, city: str | None = None) -> DataFrame:
    return city_stats(ls.filter_contains(ls.filter_recent_days(readings, days, as_of), city, "city", regex=True))


def heatmap_query(
    readings: DataFrame, limit: int, parameter: str = "aqi_index", city: str | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Sampled points and their metadata.  The sample is the feature: a map can draw only so many points."""
    source = ls.filter_contains(readings, city, "city", regex=True)
    located = source.withColumns({"lat": F.col("station_lat"), "lon": F.col("station_lon")}).where(
        F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col(parameter).isNotNull()
    )
    points = deterministic_sample(located, limit, seed, "event_id").select(
        "event_id", "lat", "lon", F.col(parameter).alias("intensity")
    )
    return points, heatmap_metadata(source, points)


def plain_recommendations(ranked: DataFrame, city: str | None = None, limit: int | None = None) -> DataFrame:
    """Ranked factory rows with defaults for missing text and numbers."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    kept = ls.filter_city_exact(ranked, city, limit, ["factory_id"])
    return kept.select(
        "factory_id",
        F.coalesce("factory_name", F.lit("Unknown Factory")).alias("factory_name"),
        F.coalesce("industry_type", F.lit("industrial")).alias("industry_type"),
        F.trim(F.coalesce("city", F.lit(""))).alias("city"),
        F.coalesce("state", F.lit("")).alias("state"),
        F.coalesce("country", F.lit("India")).alias("country"),
        number("latitude"), number("longitude"),
        rk.normalise_score_100("pollution_impact_score").alias("pollution_score"),
        F.coalesce(F.when(F.col("risk_level") != "", F.col("risk_level")), F.lit("Moderate")).alias("risk_level"),
        F.lit("PM2.5").alias("primary_pollutant"),
        number("latest_pm25"), number("latest_pm10"),
        F.coalesce(
            F.when(F.col("recommendation") != "", F.col("recommendation")),
            F.lit("Install scrubber systems and strengthen continuous monitoring."),
        ).alias("recommendation"),
    )


def plain_readings(readings: DataFrame, city: str | None = None, limit: int | None = None, order: list | None = None) -> DataFrame:
    kept = ls.filter_city_exact(readings, city, limit, order or ["event_id"])
    numbers = ["pm25", "pm10", "co", "no2", "so2", "o3", "aqi_index", "station_lat", "station_lon"]
    return kept.select(
        "event_id", "station_name", F.trim(F.coalesce("city", F.lit(""))).alias("city"),
        F.coalesce("country", F.lit("India")).alias("country"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers],
    )


def plain_sites(sites: DataFrame, city: str | None = None, limit: int | None = None) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    kept = ls.filter_city_exact(sites, city, limit, ["factory_id"])
    return kept.select(
        "factory_id",
        F.coalesce("factory_name", F.lit("Unknown Factory")).alias("factory_name"),
        F.coalesce("industry_type", F.lit("industrial")).alias("industry_type"),
        F.trim(F.coalesce("city", F.lit(""))).alias("city"),
        F.coalesce("state", F.lit("")).alias("state"),
        F.coalesce("country", F.lit("India")).alias("country"),
        number("latitude"), number("longitude"),
    )


def plain_recommendation(ranked: DataFrame, factory_id: str) -> DataFrame:
    """The plain row of one factory, or no row."""
    return plain_recommendations(ranked.where(F.col("factory_id") == factory_id), limit=1)
