"""Row-level cleaning and site enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import text as tx
from stackplume.functions.numeric import clamp, to_double
from stackplume.operators.windows import first_per_key

SITE_COLUMNS = [
    ("factory_id", "string"), ("factory_name", "string"), ("industry_type", "string"), ("latitude", "double"),
    ("longitude", "double"), ("city", "string"), ("state", "string"), ("country", "string"), ("source", "string"),
    ("osm_id", "string"), ("last_updated", "string"), ("urban_rural", "string"), ("pollution_risk_category", "string"),
    ("cluster_id", "bigint"),
]


def city_table(spark: SparkSession) -> DataFrame:
    """Fixed list of cities with state and centre."""
    return spark.createDataFrame(C.CITIES, "city string, state string, centre_lat double, centre_lon double")


def coerce_timestamp(df: DataFrame, name: str = "timestamp") -> DataFrame:
    """Readable times only, as timestamps."""
    return df.withColumn(name, F.try_to_timestamp(F.col(name).cast("string"))).where(F.col(name).isNotNull())


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in columns})


def collapse_whitespace(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: tx.collapse_whitespace(c) for c in columns})


def validate_coords_country(df: DataFrame) -> DataFrame:
    """Sites inside the country's bounding box."""
    return df.where(F.col("latitude").between(6, 38) & F.col("longitude").between(67, 98))


def coords_missing(lat: str, lon: str) -> Column:
    return F.col(lat).isNull() | F.col(lon).isNull()


def coords_outside(lat: str, lon: str) -> Column:
    inside = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    return ~coords_missing(lat, lon) & ~inside


def validate_coords_global(df: DataFrame, lat: str = "station_lat", lon: str = "station_lon") -> DataFrame:
    return df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def coords_profile(df: DataFrame, lat: str = "station_lat", lon: str = "station_lon") -> DataFrame:
    """How many rows the coordinate check drops, and why."""
    return df.agg(
        F.count_if(coords_missing(lat, lon)).alias("dropped_null"),
        F.count_if(coords_outside(lat, lon)).alias("dropped_range"),
        F.count(F.lit(1)).alias("rows"),
    )


def clip_ranges(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    ranges = ranges or C.VALID_RANGES
    return df.withColumns({c: clamp(c, low, high) for c, (low, high) in ranges.items() if c in df.columns})


def range_violations(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Out-of-range values per pollutant, from one pass."""
    ranges = {c: r for c, r in (ranges or C.VALID_RANGES).items() if c in df.columns}
    counts = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items()])
    return counts.unpivot([], list(ranges), "pollutant", "violations")


def drop_duplicate_sites(df: DataFrame, order: list) -> DataFrame:
    """First site per element id, then first per coordinates rounded to three places."""
    once = first_per_key(df, ["osm_id"], order)
    return first_per_key(once, [F.bround("latitude", 3), F.bround("longitude", 3)], order)


def normalise_sites(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "factory_name": tx.site_name("factory_name", "osm_id"),
            "industry_type": tx.industry_label("industry_type"),
        }
    )


def add_derived_fields(df: DataFrame, run_date: str) -> DataFrame:
    """Identifier, state, country, source and the run date (a parameter, not the clock)."""
    states = city_table(df.sparkSession).select("city", F.col("state").alias("_state"))
    return (
        df.join(states, "city", "left")
        .withColumns(
            {
                "factory_id": F.concat(F.lit("OSM_"), tx.site_id("osm_id")),
                "source": F.lit("OpenStreetMap"),
                "state": F.coalesce("_state", F.lit("Unknown")),
                "country": F.lit("India"),
                "last_updated": F.lit(run_date),
            }
        )
        .drop("_state")
    )


def enforce_schema(df: DataFrame, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Exactly the wanted columns in order and type; a missing text is empty and a missing whole number is -1."""
    out = []
    for name, kind in columns or SITE_COLUMNS:
        if kind == "bigint":
            value = F.coalesce(F.col(name).try_cast("bigint"), F.lit(-1)) if name in df.columns else F.lit(-1)
        elif kind == "double":
            value = to_double(F.col(name)) if name in df.columns else F.lit(None)
        else:
            value = F.col(name) if name in df.columns else F.lit("")
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def align_features(df: DataFrame, features: list[str], kind: str = "double") -> DataFrame:
    """Expected columns in the trained order, NULL where the input has none."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in features])


def quality_report(sites: DataFrame, readings: DataFrame, reports: DataFrame) -> DataFrame:
    """Data-quality checks as rows (check_name, passed, violations); one aggregate per table.

    Ratio checks tolerate one percent of values outside the range.
    """

    def outside(column: str, low: float, high: float) -> Column:
        return F.count_if(~F.col(column).between(low, high))

    def strict(counts: DataFrame, names: list[str]) -> DataFrame:
        return counts.unpivot([], names, "check_name", "violations").select(
            "check_name", (F.col("violations") == 0).alias("passed"), "violations"
        )

    def lenient(counts: DataFrame, names: list[str]) -> DataFrame:
        return counts.select(*[F.struct(F.col(n), F.col(f"{n}_rows").alias("rows")).alias(n) for n in names]).select(
            F.explode(
                F.array(*[
                    F.struct(F.lit(n).alias("check_name"), F.col(f"{n}.{n}").alias("violations"), F.col(f"{n}.rows").alias("rows"))
                    for n in names
                ])
            ).alias("c")
        ).select(
            "c.check_name",
            ((F.col("c.rows") - F.col("c.violations")) >= F.col("c.rows") * 0.99).alias("passed"),
            "c.violations",
        )

    site_counts = sites.agg(
        outside("latitude", 6, 38).alias("site_latitude_range"), F.count("latitude").alias("site_latitude_range_rows"),
        outside("longitude", 67, 98).alias("site_longitude_range"),
        F.count("longitude").alias("site_longitude_range_rows"),
        F.count_if(F.col("factory_id").contains("/")).alias("site_id_slash"),
        F.count_if(~F.coalesce(F.lower(F.trim("industry_type")).rlike("^[a-z0-9_]+$"), F.lit(False))).alias("site_industry_token"),
        F.count_if(~F.col("country").eqNullSafe("India")).alias("site_country"),
    )
    repeated = (
        sites.groupBy("factory_id").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra").alias("site_id_unique"))
        .select(F.coalesce("site_id_unique", F.lit(0)).alias("site_id_unique"))
    )
    reading_counts = readings.agg(
        *[
            F.count_if(~F.coalesce(F.col(p).between(lo, hi), F.lit(False))).alias(f"reading_{p}_range")
            for p, (lo, hi) in C.QUALITY_RANGES.items()
        ],
        F.count_if(~F.coalesce(F.col("station_lat").between(-90, 90), F.lit(False))).alias("reading_latitude_range"),
        F.count_if(~F.coalesce(F.col("station_lon").between(-180, 180), F.lit(False))).alias("reading_longitude_range"),
        F.count_if(F.col("timestamp").isNull()).alias("reading_timestamp"),
        outside("aqi_index", 0, 500).alias("reading_aqi_range"), F.count("aqi_index").alias("reading_aqi_range_rows"),
    )
    levels = ["Low", "Medium", "High", "Critical", "Unknown"]
    report_counts = reports.agg(
        F.count_if(~F.coalesce(F.col("risk_level").isin(levels), F.lit(False))).alias("report_level"),
        F.count_if(~F.coalesce(F.col("composite_score").between(0, 10), F.lit(False))).alias("report_score_range"),
    )
    reading_checks = [f"reading_{p}_range" for p in C.QUALITY_RANGES] + [
        "reading_latitude_range", "reading_longitude_range", "reading_timestamp"
    ]
    return (
        strict(site_counts, ["site_id_slash", "site_industry_token", "site_country"])
        .unionByName(lenient(site_counts, ["site_latitude_range", "site_longitude_range"]))
        .unionByName(strict(repeated, ["site_id_unique"]))
        .unionByName(strict(reading_counts, reading_checks))
        .unionByName(lenient(reading_counts, ["reading_aqi_range"]))
        .unionByName(strict(report_counts, ["report_level", "report_score_range"]))
    )


def required_columns_report(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column that the table lacks."""
    missing = [(c,) for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(missing, "missing_column string")
