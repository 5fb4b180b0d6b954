"""Parsers for landed JSON and CSV payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume import schemas
from stackplume.functions.numeric import lookup, to_double
from stackplume.functions.text import collapse_whitespace, industry_from_tags


def _given(value: Column) -> Column:
    """NULL for empty text."""
    return F.when(value != "", value)


def _parsed(df: DataFrame, payload: str, schema: str, name: str) -> DataFrame:
    """Every payload parsed once, as column ``name`` beside the other columns.

    The parsed object leaves a generator: filters on it stay above, where otherwise each condition and each field
    would parse (and make) the whole payload again.
    """
    rest = [c for c in df.columns if c != payload]
    return df.select(*rest, F.inline(F.array(F.struct(F.from_json(payload, schema).alias(name)))))


def parse_site_elements(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Map elements to site rows; elements without a position are dropped.  Other columns are kept."""
    rest = [c for c in df.columns if c != payload]
    parsed = _parsed(df, payload, schemas.SITE_ELEMENT, "e")
    kind = F.regexp_replace(F.trim(F.coalesce("e.type", F.lit(""))), "/", "_")
    local = F.coalesce("e.id", F.lit(""))
    osm_id = F.when(local == "", local).when(kind == "", local).otherwise(F.concat_ws("_", kind, local))
    own = F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()
    tags = F.coalesce("e.tags", F.create_map().cast("map<string,string>"))
    rows = parsed.select(
        *rest,
        osm_id.alias("osm_id"),
        tags.alias("tags"),
        F.when(own, F.col("e.lat")).otherwise(F.col("e.center.lat")).alias("latitude"),
        F.when(own, F.col("e.lon")).otherwise(F.col("e.center.lon")).alias("longitude"),
    ).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    tag = lambda k: _given(F.try_element_at("tags", F.lit(k)))
    sorted_tags = F.map_from_entries(F.array_sort(F.map_entries("tags")))
    return rows.select(
        *rest,
        "osm_id",
        F.coalesce(tag("name"), tag("operator"), F.concat(F.lit("Industrial_"), "osm_id")).alias("factory_name"),
        industry_from_tags("tags").alias("industry_type"),
        "latitude",
        "longitude",
        F.to_json(sorted_tags).alias("raw_tags"),
    )


def sanitise_sites(df: DataFrame) -> DataFrame:
    columns = [c for c in ("factory_name", "industry_type", "city") if c in df.columns]
    return df.withColumns({c: collapse_whitespace(c) for c in columns})


def parse_measurements(df: DataFrame, payload: str = "payload", requested_city: str | None = None) -> DataFrame:
    """Measurement payloads in any of their shapes to long rows; unknown pollutants and undated rows are dropped.

    ``requested_city`` names the column with the city the payload was fetched for; it replaces a missing city.
    """
    rest = [c for c in df.columns if c != payload]
    parsed = _parsed(df, payload, schemas.MEASUREMENT, "m")
    # A nested object read as text keeps its JSON, from which the name is taken.
    named = lambda c: F.when(F.col(c).startswith("{"), F.get_json_object(c, "$.name")).otherwise(F.col(c))
    parameter = F.lower(F.coalesce(named("m.parameter"), F.lit("")))
    moment = F.coalesce(
        _given(F.col("m.date.utc")), _given(F.col("m.datetime")),
        _given(F.col("m.period.datetimeFrom.utc")), _given(F.col("m.period.datetimeTo.utc")),
    )
    city = _given(F.col("m.city"))
    city = F.when(city != "Unknown", city)
    fallback = F.coalesce(F.col(requested_city), F.lit("Unknown")) if requested_city else F.lit("Unknown")
    return parsed.select(
        *rest,
        F.coalesce(_given(F.col("m.location")), F.lit("Unknown Station")).alias("station_name"),
        moment.alias("timestamp"),
        parameter.alias("parameter"),
        F.col("m.value").alias("value"),
        F.col("m.coordinates.latitude").alias("station_lat"),
        F.col("m.coordinates.longitude").alias("station_lon"),
        F.coalesce(city, fallback).alias("reading_city"),
        F.coalesce(_given(named("m.country")), F.lit("India")).alias("country"),
    ).where(F.col("parameter").isin(C.POLLUTANTS) & F.col("timestamp").isNotNull())


def parse_open_records(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Open-data records to long rows; unknown pollutants and unreadable times are dropped, bad numbers are NULL."""
    rest = [c for c in df.columns if c != payload]
    parsed = _parsed(df, payload, schemas.OPEN_RECORD, "r")
    pick = lambda *names: F.coalesce(*[_given(F.col(f"r.{n}")) for n in names])
    return parsed.select(
        *rest,
        F.trim(F.coalesce(pick("station", "station_name"), F.lit("Unknown Station"))).alias("station_name"),
        F.try_to_timestamp(pick("last_update", "timestamp")).alias("timestamp"),
        lookup(C.OPEN_DATA_PARAMETERS, F.upper(F.trim(pick("pollutant_id", "parameter")))).alias("parameter"),
        to_double(pick("pollutant_avg", "value")).alias("value"),
        F.trim(F.coalesce(pick("city", "state"), F.lit("Unknown"))).alias("reading_city"),
        F.lit("India").alias("country"),
    ).where(F.col("parameter").isNotNull() & F.col("timestamp").isNotNull())


def normalise_backfill(df: DataFrame) -> DataFrame:
    """Wide backfill table with any of the known header spellings; without its key columns it counts as empty."""
    names = [C.BACKFILL_HEADERS.get(c.lower().strip(), c.lower().strip()) for c in df.columns]
    renamed = df.toDF(*names)
    if not {"station_name", "timestamp"} <= set(names):
        return renamed.limit(0)
    numbers = {
        c: to_double(F.col(c)) if c in names else F.lit(None).cast("double")
        for c in [*C.POLLUTANTS, "station_lat", "station_lon"]
    }
    texts = {
        "city": F.coalesce(F.col("city"), F.lit("Unknown")) if "city" in names else F.lit("Unknown"),
        "country": F.coalesce(F.col("country"), F.lit("India")) if "country" in names else F.lit("India"),
        "timestamp": F.try_to_timestamp(F.col("timestamp").cast("string")),
    }
    return renamed.withColumns({**numbers, **texts}).where(F.col("timestamp").isNotNull())


def scan_backfill(spark, path: str) -> DataFrame:
    return normalise_backfill(spark.read.option("header", True).csv(path))
