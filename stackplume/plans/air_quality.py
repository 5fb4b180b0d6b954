"""Index columns for every reading and their daily roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.functions import aqi


def index_readings(readings: DataFrame) -> DataFrame:
    """All index variants.  Expects ``aqi_index`` (may be NULL), pm25 and pm10."""
    return readings.withColumns(
        {
            "aqi_national": aqi.aqi_pm25_national(),
            "aqi_pm25_epa": aqi.aqi_pm25_epa(),
            "aqi_pm10_epa": aqi.aqi_pm10_epa(),
            "aqi": aqi.aqi_coalesced(),
            "aqi_source": aqi.aqi_source(),
            "aqi_from_pm": aqi.aqi_from_pm(),
            "aqi_category": aqi.aqi_from_pm_category(),
        }
    ).withColumn("aqi_band", aqi.aqi_band_national("aqi"))


def city_day_index(readings: DataFrame) -> DataFrame:
    """Highest and mean index per city and day."""
    return (
        index_readings(readings)
        .groupBy("city", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
        .agg(
            F.max("aqi").alias("max_aqi"), F.avg("aqi").alias("mean_aqi"),
            F.max("aqi_from_pm").alias("max_epa"), F.count(F.lit(1)).alias("readings"),
        )
    )
