"""Joins between sites, readings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import risk as rk
from stackplume.functions.text import reading_key
from stackplume.operators.aggregates import attach, column_means
from stackplume.operators.windows import first_per_key
from stackplume.session import ensure_checkpoint_dir


def city_levels(readings: DataFrame, order: list, max_km: float) -> DataFrame:
    """One stored row per city from one scan: sums and counts of every pollutant, and its first nearby reading."""
    ensure_checkpoint_dir(readings.sparkSession)
    nearby = F.col("nearest_factory_distance_km") <= max_km
    # The smallest struct is the first row in ``order``, NULLs first, since order columns come before the values.
    places = [c.alias(f"o{i}") for i, c in enumerate(order)]
    first = F.min(F.when(nearby, F.struct(*places, F.struct(*C.POLLUTANTS).alias("values"))))["values"]
    return readings.groupBy("city").agg(
        first.alias("_direct_values"), F.max(nearby).alias("_direct"),
        *[F.sum(p).alias(f"_sum_{p}") for p in C.POLLUTANTS], *[F.count(p).alias(f"_count_{p}") for p in C.POLLUTANTS],
    ).checkpoint()


def match_readings(sites: DataFrame, readings: DataFrame, order: list, max_km: float = 100.0) -> DataFrame:
    """One pollutant row per site: the first nearby reading of its city in ``order``, else the city mean, else the mean
    of all readings.  ``match_tier`` says which.  The readings are read once and reduced to one row per city; the means
    of all readings are rolled up from the cities.
    """
    levels = city_levels(readings, order, max_km)
    mean = lambda p, total: F.try_divide(total(f"_sum_{p}"), total(f"_count_{p}")).alias(p)
    by_city = levels.select(
        "city", "_direct", "_direct_values", F.struct(*[mean(p, F.col) for p in C.POLLUTANTS]).alias("_city_values")
    )
    known = attach(sites.join(by_city, "city", "left"), levels.agg(*[mean(p, F.sum) for p in C.POLLUTANTS]), "_national")
    in_city = F.col("_city_values").isNotNull()
    values = F.when(F.col("_direct"), F.col("_direct_values")).when(in_city, F.col("_city_values")).otherwise(F.col("_national"))
    tier = F.when(F.col("_direct"), F.lit("station")).when(in_city, F.lit("city")).otherwise(F.lit("national"))
    return known.withColumns({"_values": values, "match_tier": tier}).select(
        *sites.columns, *[F.col(f"_values.{p}").alias(p) for p in C.POLLUTANTS], "match_tier"
    )


def match_nearest(sites: DataFrame, readings: DataFrame, max_km: float = 100.0, tie: str = "event_id") -> DataFrame:
    """Nearest-reading variant.  The distance of a reading is to its own nearest site."""
    return match_readings(sites, readings, [F.col("nearest_factory_distance_km"), F.col(tie)], max_km)


def match_first(sites: DataFrame, readings: DataFrame, max_km: float = 100.0, tie: str = "event_id") -> DataFrame:
    """First-row variant, in time order; without distances every site gets the overall mean."""
    if "nearest_factory_distance_km" not in readings.columns or "city" not in readings.columns:
        known = attach(sites, column_means(readings, C.POLLUTANTS), "_national")
        return known.select(
            *sites.columns, *[F.col(f"_national.{p}").alias(p) for p in C.POLLUTANTS], F.lit("national").alias("match_tier")
        )
    return match_readings(sites, readings, [F.col("timestamp"), F.col(tie)], max_km)


def tier_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("match_tier").agg(F.count(F.lit(1)).alias("sites"))


def add_risk(matched: DataFrame) -> DataFrame:
    """Scores, composite, level and dominant pollutant of a matched site."""
    return (
        matched.select("*", *rk.score_columns())
        .withColumn("composite_score", rk.composite_risk())
        .withColumns({"risk_level": rk.risk_band_4("composite_score"), "dominant_pollutant": rk.dominant_pollutant()})
    )


def attach_first_recommendation(sites: DataFrame, recommendations: DataFrame, order: list) -> DataFrame:
    """Sites with the first recommendation row of each; a clashing column keeps the site's name and gains ``_rec``."""
    first = first_per_key(recommendations, ["factory_id"], order)
    renamed = first.select(
        "factory_id",
        *[F.col(c).alias(f"{c}_rec" if c in sites.columns else c) for c in first.columns if c != "factory_id"],
    )
    return sites.join(renamed, "factory_id", "left")


def site_detail(sites: DataFrame, recommendations: DataFrame, site: str | Column, order: list) -> DataFrame:
    """One site with its first recommendation; no row for an unknown id."""
    picked = sites.where(F.col("factory_id") == site)
    mine = recommendations.where(F.col("factory_id") == site)
    return attach_first_recommendation(picked, mine, order)


def bulk_lookup(sites: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the requested ids, and an error row per id that does not exist."""
    found = wanted.join(sites, "factory_id")
    missing = wanted.join(sites.select("factory_id"), "factory_id", "left_anti").select(
        "factory_id", F.concat(F.lit("Factory '"), "factory_id", F.lit("' not found")).alias("error")
    )
    return found, missing


def backfill_suppress(backfill: DataFrame, existing: DataFrame) -> DataFrame:
    """Backfill rows whose station and second are not yet in the existing table."""
    keys = existing.select(reading_key("station_name", "timestamp").alias("_key")).distinct()
    return (
        backfill.withColumn("_key", reading_key("station_name", "timestamp")).join(keys, "_key", "left_anti").drop("_key")
    )


def lookup_enrich(df: DataFrame, table: DataFrame, key: Column, value: str, name: str, default) -> DataFrame:
    """Value of a fixed lookup table (columns key, value), or the default."""
    renamed = table.select(F.col("key").alias("_key"), F.col(value).alias("_value"))
    return (
        df.withColumn("_lookup", key)
        .join(renamed, F.col("_lookup") == F.col("_key"), "left")
        .withColumn(name, F.coalesce("_value", F.lit(default)))
        .drop("_lookup", "_key", "_value")
    )


def growth_and_urbanisation(df: DataFrame) -> DataFrame:
    """Yearly growth of the industry (any case, blanks or underscores) and urbanisation factor of the city."""
    spark = df.sparkSession
    growth = spark.createDataFrame([(k.lower(), v) for k, v in C.INDUSTRY_GROWTH.items()], "key string, rate double")
    urban = spark.createDataFrame(list(C.CITY_URBANISATION.items()), "key string, factor double")
    industry = F.lower(F.translate("industry_type", "_", " "))
    with_growth = lookup_enrich(df, growth, industry, "rate", "industry_growth", C.DEFAULT_GROWTH)
    return lookup_enrich(with_growth, urban, F.col("city"), "factor", "city_urbanization", C.DEFAULT_URBANISATION)


def overlay_latest(cached: DataFrame, live: DataFrame, key: str = "factory_id") -> DataFrame:
    """Live pollutant values over the cached ones where there is a live value."""
    renamed = live.select(key, *[F.col(p).alias(f"_{p}") for p in C.POLLUTANTS])
    return (
        cached.join(renamed, key, "left")
        .withColumns({p: F.coalesce(f"_{p}", p) for p in C.POLLUTANTS})
        .select(*cached.columns)
    )


def filter_city_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """Rows whose city contains a target or is contained in one, any case (a short list of names)."""
    city = F.lower(F.coalesce("city", F.lit("")))
    wanted = F.array(*[F.lit(t.lower()) for t in targets])
    return df.where(F.exists(wanted, lambda t: city.contains(t) | t.contains(city)))
