"""Nested site reports and their flat, summary and map forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import aqi, risk as rk
from stackplume.functions.numeric import column, lookup, printed
from stackplume.operators import rules
from stackplume.operators.aggregates import coordinate_columns
from stackplume.operators.windows import first_per_key

CSV_COLUMNS = [
    "factory_id", "factory_name", "industry_type", "city", "risk_level", "composite_score", "dominant_pollutant",
    "immediate_actions", "short_term_actions", "long_term_actions", "monitoring_actions", "summary", "generated_at",
]


def assemble_reports(scored: DataFrame, generated_at: str, categories: Column | None = None) -> DataFrame:
    """Nested report per scored site; a missing score shows as 0.0 while its level stays Unknown."""
    actions = rules.merged_actions(categories)
    scores = [F.coalesce(f"{p}_score", F.lit(0.0)).alias(f"{p}_score") for p in C.SCORED_POLLUTANTS]
    with_actions = scored.withColumn("recommendations", actions)
    top = F.coalesce(F.try_element_at("recommendations", F.lit(1))["action"], F.lit("No specific recommendation available"))
    return with_actions.select(
        "factory_id", "factory_name", "industry_type", "city", "risk_level",
        F.coalesce("composite_score", F.lit(0.0)).alias("composite_score"),
        "dominant_pollutant",
        F.struct(*scores).alias("pollution_scores"),
        "recommendations",
        rk.report_summary("factory_name", "risk_level", "composite_score", top).alias("summary"),
        F.lit(generated_at).alias("generated_at"),
    )


def order_by_score(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.col("composite_score").desc(), "factory_id")


def reports_to_summary(reports: DataFrame) -> DataFrame:
    texts = ["factory_id", "factory_name", "industry_type", "city"]
    return reports.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
        F.coalesce("risk_level", F.lit("Low")).alias("risk_level"),
        F.coalesce("composite_score", F.lit(0.0)).alias("composite_score"),
        F.coalesce("dominant_pollutant", F.lit("")).alias("dominant_pollutant"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "generated_at",
    )


def _joined(condition) -> Column:
    return F.array_join(F.transform(F.filter("recommendations", condition), lambda r: r["action"]), " | ")


def reports_to_flat(reports: DataFrame) -> DataFrame:
    """Actions of each priority, and of monitoring, joined into one text each."""
    return reports.select(
        "factory_id", "factory_name", "industry_type", "city", "risk_level",
        F.bround("composite_score", 4).alias("composite_score"),
        "dominant_pollutant",
        _joined(lambda r: r["priority"] == "Immediate").alias("immediate_actions"),
        _joined(lambda r: r["priority"] == "Short-term").alias("short_term_actions"),
        _joined(lambda r: r["priority"] == "Long-term").alias("long_term_actions"),
        _joined(lambda r: F.lower(r["category"]) == "monitoring").alias("monitoring_actions"),
        "summary",
        "generated_at",
    )


def top_critical(reports: DataFrame, k: int = 10) -> DataFrame:
    top = F.coalesce(F.try_element_at("recommendations", F.lit(1))["action"], F.lit("No recommendation"))
    return order_by_score(reports).limit(k).select(
        "factory_name", "risk_level", "composite_score", "dominant_pollutant", top.alias("top_action")
    )


def heatmap_points(df: DataFrame, value: str) -> DataFrame:
    """lat, lon, intensity of rows that have all three inside the globe."""
    lat, lon = coordinate_columns(df)
    return df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & F.col(value).isNotNull()).select(
        F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(value).alias("intensity")
    )


def points_to_features(points: DataFrame) -> DataFrame:
    """One GeoJSON point feature per row; intensity is a share of 100, at most 1."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.least(F.col("intensity") / 100, F.lit(1.0)).alias("intensity")).alias("properties"),
    )
    return points.select(F.to_json(feature).alias("feature"))


def _shown_text(value) -> Column:
    text = F.trim(column(value))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("N/A")).otherwise(text)


def _shown_number(value) -> Column:
    return F.when(column(value).isNull(), F.lit("N/A")).otherwise(printed(value, 2))


def station_markers(readings: DataFrame, order: list) -> DataFrame:
    """First reading per coordinates with band, colour and display texts."""
    lat, lon = coordinate_columns(readings)
    located = readings.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    first = first_per_key(located, [lat, lon], order)
    index = F.col("aqi_index")
    return first.select(
        F.col(lat).alias("lat"), F.col(lon).alias("lon"),
        F.when(index.isNull(), F.lit("#808080")).otherwise(aqi.aqi_colour_national(index)).alias("colour"),
        F.when(index.isNull(), F.lit("Unknown")).otherwise(aqi.aqi_band_national(index)).alias("band"),
        _shown_text("station_name").alias("station"), _shown_text("city").alias("city"),
        _shown_number("pm25").alias("pm25"), _shown_number("pm10").alias("pm10"), _shown_number("aqi_index").alias("aqi"),
        _shown_text(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.concat(_shown_text("station_name"), F.lit(" | AQI: "), _shown_number("aqi_index")).alias("tooltip"),
    )


def station_pins(readings: DataFrame, order: list) -> DataFrame:
    """First reading per station name and coordinates (the dashboard's station layer)."""
    first = first_per_key(readings, ["station_name", "station_lat", "station_lon"], order)
    return first.select("station_name", "station_lat", "station_lon", "pm25", "pm10", "city")


def site_markers(sites: DataFrame) -> DataFrame:
    """Map marker per ranked site (expects the ranked factory table)."""
    level = F.coalesce("risk_level", F.lit("Low"))
    return sites.select(
        "factory_id", "latitude", "longitude",
        lookup(C.RISK_COLOURS, level, C.DEFAULT_RISK_COLOUR).alias("colour"),
        rk.influence_radius_m(level).alias("influence_radius_m"),
        "factory_name", "industry_type", printed("pollution_impact_score", 2).alias("score_text"),
        level.alias("risk_level"), "recommendation",
    )
