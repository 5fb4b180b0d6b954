"""Tables behind the maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.functions.numeric import printed
from stackplume.operators import reports as rp
from stackplume.operators.aggregates import (
    intensity_column, map_center, mean_center, minmax_intensity, timestamp_range, top_polluted_cities,
)
from stackplume.operators.cleaning import validate_coords_global


def heatmap_tables(readings: DataFrame, order: list) -> dict[str, DataFrame]:
    """Points, station markers, city labels, centre and time range of the heat map."""
    located = validate_coords_global(readings)
    scaled = minmax_intensity(located, intensity_column(located))
    return {
        "points": rp.heatmap_points(scaled, "intensity_normalized"),
        "stations": rp.station_markers(located, order),
        "cities": top_polluted_cities(located),
        "centre": map_center(located),
        "time_range": timestamp_range(located),
    }


def dashboard_tables(readings: DataFrame, ranked: DataFrame, order: list) -> dict[str, DataFrame]:
    """The heat-map tables plus the site markers, station pins and dashboard centre."""
    tables = heatmap_tables(readings, order)
    tables["sites"] = rp.site_markers(ranked)
    tables["pins"] = rp.station_pins(validate_coords_global(readings), order)
    tables["centre"] = mean_center(ranked)
    return tables


def city_labels(cities: DataFrame) -> DataFrame:
    return cities.select("lat", "lon", F.concat("city", F.lit(" | AQI "), printed("avg_aqi", 1)).alias("label"))
