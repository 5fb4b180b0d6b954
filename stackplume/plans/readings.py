"""Reading table from the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.aqi import naive_aqi
from stackplume.operators.aggregates import impute_medians, pivot_measurements
from stackplume.operators.cleaning import clip_ranges, coerce_timestamp
from stackplume.operators.nearest import nearest_distance_in_city
from stackplume.operators.windows import first_per_key
from stackplume.session import ensure_checkpoint_dir
from stackplume.sources.payloads import parse_measurements, parse_open_records


def wide_from_long(long: DataFrame, sequence: str = "seq") -> DataFrame:
    return pivot_measurements(long.withColumnRenamed("reading_city", "city"), sequence)


def readings_from_measurements(payloads: DataFrame, sequence: str = "seq", requested_city: str | None = None) -> DataFrame:
    return wide_from_long(parse_measurements(payloads, requested_city=requested_city), sequence)


def readings_from_open_records(payloads: DataFrame, sequence: str = "seq") -> DataFrame:
    """The open-data records carry no station coordinates."""
    wide = wide_from_long(parse_open_records(payloads), sequence)
    return wide.withColumns({c: F.lit(None).cast("double") for c in ("station_lat", "station_lon")})


def raw_readings(readings: DataFrame, sites: DataFrame, order: list, threshold_km: float = 50.0) -> DataFrame:
    """Index, readable times, one row per station, time and source, and near enough to a site of the city."""
    timed = coerce_timestamp(readings.withColumn("aqi_index", naive_aqi()))
    once = first_per_key(timed, ["station_name", "timestamp", "source"], order)
    return nearest_distance_in_city(once, sites, threshold_km)


def clean_readings(raw: DataFrame) -> DataFrame:
    return impute_medians(clip_ranges(raw), [*C.POLLUTANTS, "aqi_index"])


def build_readings(readings: DataFrame, sites: DataFrame, order: list, threshold_km: float = 50.0) -> DataFrame:
    """Raw and cleaned readings in one go.  The raw table is stored, because the two medians and the fill read it."""
    ensure_checkpoint_dir(readings.sparkSession)
    return clean_readings(raw_readings(readings, sites, order, threshold_km).checkpoint())
