"""B: cleaning, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import risk as rk
from stackplume.functions import text as tx
from stackplume.operators import cleaning as cl
from stackplume.operators import listing as ls
from stackplume.operators import matching as mt
from stackplume.operators.nearest import urban_rural
from stackplume.plans.sites import clean_sites, raw_sites
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.queries_sources import COPIES
from stackplume.testbed.sqltext import case_sql, hav, num, r6 as s6, sql, title_sql, values_sql

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(
    "B1_coerce_timestamp",
    sql("readings", "SELECT event_id, strftime(timestamp,'%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM readings WHERE event_id%7<>3"),
)
def coerce_timestamp(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    text = F.when(F.col("event_id") % 7 == 3, F.lit("not a time")).otherwise(F.col("timestamp").cast("string"))
    return cl.coerce_timestamp(r.withColumn("timestamp", text)).select("event_id", F.date_format("timestamp", STAMP).alias("timestamp"))


@query(
    "B2_coerce_numeric",
    sql("readings", "SELECT event_id, CASE WHEN event_id%9<>4 THEN round(pm25,6) END AS pm25, round(pm10,6) AS pm10 FROM readings"),
)
def coerce_numeric(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    odd = F.col("event_id") % 18
    text = F.when(odd == 4, F.lit("n/a")).when(odd == 13, F.lit("NaN")).otherwise(F.col("pm25").cast("string"))
    return cl.coerce_numeric(r.withColumn("pm25", text), ["pm25", "pm10"]).select("event_id", *r6("pm25", "pm10"))


@query(
    "B3_collapse_whitespace",
    "SELECT doc_id, md5(trim(regexp_replace(coalesce(text,''),'[ \\t\\n\\x0B\\f\\r]+',' ','g'))) AS digest FROM documents",
)
def collapse_whitespace(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cl.collapse_whitespace(docs, ["text"]).select("doc_id", F.md5("text").alias("digest"))


@query(
    "B4_classify_industry",
    sql("keyed", "SELECT factory_id, CASE k%7 WHEN 0 THEN 'steel' WHEN 1 THEN 'chemical' WHEN 2 THEN 'general_industrial' WHEN 3 THEN 'manufacturing' "
        "WHEN 4 THEN 'factory' WHEN 5 THEN 'textile' ELSE 'unknown' END AS industry FROM keyed"),
)
def classify_industry(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % 7 + 1).cast("int"))
    tags = F.create_map(
        F.lit("industrial"), pick(["Steel mill", "Oil REFINERY", "", "", "", "garment power", ""]),
        F.lit("landuse"), pick(["industrial", "", "Industrial", "", "", "", "farm"]),
        F.lit("man_made"), pick(["", "", "", "works", "", "", ""]),
        F.lit("amenity"), pick(["", "", "", "", "factory", "", ""]),
    )
    return k.select("factory_id", tx.industry_from_tags(tags).alias("industry"))


_NAMES = (
    "named AS (SELECT factory_id, k, CASE k%6 WHEN 0 THEN NULL WHEN 1 THEN '3m a-b  (india) ltd.' WHEN 2 THEN '@@@' WHEN 3 THEN 'O''NEIL & sons' "
    "WHEN 4 THEN concat(lower(factory_name),'/x2y') ELSE factory_name END AS raw FROM keyed), "
    "kept AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(raw,''),'[^A-Za-z0-9\\s\\-&]',' ','g'),'\\s+',' ','g')) AS clean FROM named)"
)


@query(
    "B5_normalize_site_name",
    sql("keyed", f"SELECT factory_id, CASE WHEN clean<>'' THEN {title_sql('clean')} ELSE concat('Industrial_Facility_',factory_id) END AS name FROM kept", _NAMES),
)
def normalize_site_name(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites
    odd = F.col("k") % 6
    raw = (
        F.when(odd == 0, F.lit(None).cast("string")).when(odd == 1, F.lit("3m a-b  (india) ltd.")).when(odd == 2, F.lit("@@@"))
        .when(odd == 3, F.lit("O'NEIL & sons")).when(odd == 4, F.concat(F.lower("factory_name"), F.lit("/x2y")))
        .otherwise(F.col("factory_name"))
    )
    return k.withColumn("raw", raw).select("factory_id", tx.site_name("raw", "factory_id").alias("name"))


@query(
    "B6_normalize_industry",
    sql("keyed", "SELECT factory_id, CASE WHEN k%8=0 THEN 'unknown' WHEN k%8=1 THEN 'automotive' WHEN k%8=2 THEN 'works' ELSE "
        f"{case_sql('industry_type', C.INDUSTRY_ALIASES, 'industry_type')} END AS industry FROM keyed"),
)
def normalize_industry(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites
    odd = F.col("k") % 8
    raw = (
        F.when(odd == 0, F.when(F.col("k") % 16 == 0, F.lit("  ")))
        .when(odd == 1, F.lit(" Automobile ")).when(odd == 2, F.lit("MANUFACTURING"))
        .otherwise(F.concat(F.lit(" "), F.upper("industry_type")))
    )
    return k.withColumn("raw", raw).select("factory_id", tx.industry_label("raw").alias("industry"))


@query(
    "B7_normalize_site_id",
    sql("keyed", "SELECT factory_id, CASE k%7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' WHEN 3 THEN concat('way_',k) "
        "ELSE substr(factory_id,5) END AS site FROM keyed"),
)
def normalize_site_id(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites
    odd = F.col("k") % 7
    raw = (
        F.when(odd == 0, F.lit(None).cast("string")).when(odd == 1, F.lit(" NaN ")).when(odd == 2, F.lit("//"))
        .when(odd == 3, F.concat(F.lit("/way//"), "k", F.lit("_")))
        .otherwise(F.substring("factory_id", 5, 100))
    )
    return k.withColumn("raw", raw).select("factory_id", tx.site_id("raw").alias("site"))


@query(
    "B8_add_derived_site_fields",
    sql("keyed", "SELECT factory_id, concat('OSM_',substr(factory_id,5)) AS derived_id, 'OpenStreetMap' AS source, state, 'India' AS country, "
        "'2024-02-01' AS last_updated FROM keyed"),
)
def add_derived_fields(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites.withColumn("original", F.col("factory_id"))
    out = cl.add_derived_fields(k.withColumn("osm_id", F.regexp_replace(F.substring("factory_id", 5, 100), "_", "/")), "2024-02-01")
    return out.select(F.col("original").alias("factory_id"), F.col("factory_id").alias("derived_id"), "source", "state", "country", "last_updated")


_SHIFTED = (
    "shifted AS (SELECT event_id, CASE WHEN event_id%31=0 THEN station_lat+80 ELSE station_lat END AS station_lat, "
    "CASE WHEN event_id%37=0 THEN station_lon-270 ELSE station_lon END AS station_lon FROM readings)"
)


def _shifted(spark, sf_dir):
    return Inputs(spark, sf_dir).readings.withColumns(
        {
            "station_lat": F.when(F.col("event_id") % 31 == 0, F.col("station_lat") + 80).otherwise(F.col("station_lat")),
            "station_lon": F.when(F.col("event_id") % 37 == 0, F.col("station_lon") - 270).otherwise(F.col("station_lon")),
        }
    )


@query(
    "B9_validate_coords_country",
    sql("readings", "SELECT event_id, " + s6("station_lat station_lon") + " FROM shifted WHERE station_lat BETWEEN 6 AND 38 AND station_lon BETWEEN 67 AND 98", _SHIFTED),
)
def validate_coords_country(spark, sf_dir):
    renamed = _shifted(spark, sf_dir).withColumnsRenamed({"station_lat": "latitude", "station_lon": "longitude"})
    out = cl.validate_coords_country(renamed)
    return out.select("event_id", F.round("latitude", 6).alias("station_lat"), F.round("longitude", 6).alias("station_lon"))


@query(
    "B10_validate_coords_global",
    sql("readings", "SELECT event_id FROM shifted WHERE station_lat BETWEEN -90 AND 90 AND station_lon BETWEEN -180 AND 180", _SHIFTED),
)
def validate_coords_global(spark, sf_dir):
    return cl.validate_coords_global(_shifted(spark, sf_dir)).select("event_id")


@query(
    "B10_coords_profile",
    sql("readings", "SELECT count(*) FILTER (station_lat IS NULL OR station_lon IS NULL) AS dropped_null, count(*) FILTER (station_lat IS NOT NULL AND station_lon IS NOT NULL "
        "AND NOT (station_lat BETWEEN -90 AND 90 AND station_lon BETWEEN -180 AND 180)) AS dropped_range, count(*) AS rows FROM shifted", _SHIFTED),
)
def coords_profile(spark, sf_dir):
    return cl.coords_profile(_shifted(spark, sf_dir))


def _clip_sql(c: str) -> str:
    lo, hi = C.VALID_RANGES[c]
    return f"round(CASE WHEN {c}<{num(lo)} THEN {num(lo)} WHEN {c}>{num(hi)} THEN {num(hi)} ELSE {c} END,6) AS {c}"


@query("B11_clip_ranges", sql("readings", f"SELECT event_id, {', '.join(_clip_sql(c) for c in C.POLLUTANTS)} FROM readings"))
def clip_ranges(spark, sf_dir):
    return cl.clip_ranges(Inputs(spark, sf_dir).readings).select("event_id", *r6(*C.POLLUTANTS))


@query(
    "B12_range_violation_report",
    sql("readings", " UNION ALL ".join(
        f"SELECT '{c}' AS pollutant, count(*) FILTER ({c}<{num(lo)} OR {c}>{num(hi)}) AS violations FROM readings" for c, (lo, hi) in C.VALID_RANGES.items()
    )),
)
def range_violations(spark, sf_dir):
    return cl.range_violations(Inputs(spark, sf_dir).readings)


@query("B13_filter_city_contains", sql("readings", "SELECT event_id, city FROM readings WHERE lower(city) LIKE '%en%'"))
def filter_city_contains(spark, sf_dir):
    return ls.filter_contains(Inputs(spark, sf_dir).readings, "EN").select("event_id", "city")


@query("B13_filter_city_pattern", sql("readings", "SELECT event_id, city FROM readings WHERE regexp_matches(city,'(?i)^(del|mum)')"))
def filter_city_pattern(spark, sf_dir):
    return ls.filter_contains(Inputs(spark, sf_dir).readings, "^(DEL|mum)", regex=True).select("event_id", "city")


@query(
    "B14_filter_city_exact",
    sql("readings", "SELECT event_id, city FROM readings WHERE lower(trim(city))='pune' ORDER BY event_id LIMIT 250"),
)
def filter_city_exact(spark, sf_dir):
    return ls.filter_city_exact(Inputs(spark, sf_dir).readings, "PUNE", 250, ["event_id"]).select("event_id", "city")


@query(
    "B15_filter_city_targets",
    sql("readings", "SELECT event_id, city FROM readings WHERE city IN ('Delhi','Chennai','Mumbai')"),
)
def filter_city_targets(spark, sf_dir):
    return mt.filter_city_targets(Inputs(spark, sf_dir).readings, ["New Delhi NCR", "chenn", "MUMBAI"]).select("event_id", "city")


@query("B16_filter_parameter_present", sql("readings", "SELECT event_id, round(o3,6) AS o3 FROM readings WHERE o3 IS NOT NULL"))
def filter_parameter_present(spark, sf_dir):
    r = ls.filter_parameter_present(Inputs(spark, sf_dir).readings, "o3")
    return ls.filter_parameter_present(r, "no_such_column").select("event_id", *r6("o3"))


@query(
    "B17_filter_date_range",
    sql("readings", "SELECT event_id FROM readings WHERE timestamp>=TIMESTAMP '2024-01-05' AND timestamp<TIMESTAMP '2024-01-13'"),
)
def filter_date_range(spark, sf_dir):
    return ls.filter_date_range(Inputs(spark, sf_dir).readings, "2024-01-05", "2024-01-12").select("event_id")


@query(
    "B18_filter_recent_days",
    sql("readings", "SELECT event_id FROM readings WHERE timestamp>=(SELECT max(timestamp) FROM readings)-INTERVAL 7 DAY"),
)
def filter_recent_days(spark, sf_dir):
    return ls.filter_recent_days(Inputs(spark, sf_dir).readings, 7).select("event_id")


@query("B19_filter_risk_level", sql("scored", "SELECT factory_id, risk_level FROM scored WHERE lower(risk_level)='medium'"))
def filter_risk_level(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return ls.filter_equal_text(t.reports, "MEDIUM", "risk_level").select("factory_id", "risk_level")


@query(
    "B20_season",
    "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'winter' WHEN month(o_orderdate) IN (3,4,5) THEN 'summer' "
    "WHEN month(o_orderdate) IN (6,7,8) THEN 'monsoon' WHEN month(o_orderdate) IN (9,10,11) THEN 'post_monsoon' ELSE 'unknown' END AS season FROM orders",
)
def season(spark, sf_dir):
    # The readings cover one month only; the order dates cover all of them.
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", tx.season("o_orderdate").alias("season"))


@query(
    "B21_industry_risk_weight",
    sql("factories", f"SELECT factory_id, {case_sql('industry_type', C.INDUSTRY_RISK_WEIGHT, '6')} AS weight FROM factories"),
)
def industry_risk_weight(spark, sf_dir):
    return Inputs(spark, sf_dir).factories.select("factory_id", tx.industry_weight(F.upper("industry_type")).alias("weight"))


@query(
    "B23_risk_category_by_industry",
    sql("factories", "SELECT factory_id, CASE WHEN industry_type IN ('chemical','steel','power','pharmaceutical','cement') THEN 'High' "
        "WHEN industry_type IN ('manufacturing','automotive','paper','food_processing') THEN 'Medium' ELSE 'Low' END AS category FROM factories"),
)
def risk_category(spark, sf_dir):
    f = Inputs(spark, sf_dir).factories
    return f.select("factory_id", tx.risk_category(F.when(F.col("industry_type") != "unknown", F.initcap("industry_type"))).alias("category"))


_CENTRES = "centres AS " + values_sql([(c, lat, lon) for c, _, lat, lon in C.CITIES], "city, clat, clon", "t")


@query(
    "B24_urban_rural",
    sql("readings", "SELECT event_id, CASE WHEN clat IS NULL THEN 'unknown' WHEN station_lat IS NULL THEN 'rural' WHEN d<15 THEN 'urban' WHEN d<=40 THEN 'peri-urban' ELSE 'rural' END AS urban_rural "
        f"FROM (SELECT r.event_id, r.station_lat, c.clat, {hav('r.station_lat', 'r.station_lon', 'c.clat', 'c.clon')} AS d FROM readings r LEFT JOIN centres c ON c.city=r.city)", _CENTRES),
)
def urban_rural_class(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.withColumnsRenamed({"station_lat": "latitude", "station_lon": "longitude"})
    return urban_rural(r, cl.city_table(spark)).select("event_id", "urban_rural")


@query(
    "B25_enforce_schema",
    sql("factories", "SELECT factory_id, factory_name, industry_type, city, state, country, '' AS source, '' AS osm_id, '' AS last_updated, '' AS urban_rural, "
        "'' AS pollution_risk_category, CAST(-1 AS BIGINT) AS cluster_id, " + s6("latitude longitude") + " FROM factories"),
)
def enforce_schema(spark, sf_dir):
    out = cl.enforce_schema(Inputs(spark, sf_dir).factories)
    return out.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(
    "B27_normalize_score_100",
    sql("readings", "SELECT event_id, CAST(round_even(s,0) AS BIGINT) AS score, CAST(floor(s+0.5e0) AS BIGINT) AS page_score FROM "
        "(SELECT event_id, CASE WHEN coalesce(pm25,55)<=10 THEN coalesce(pm25,55)*10 ELSE coalesce(pm25,55) END AS s FROM readings)"),
)
def normalize_score_100(spark, sf_dir):
    return Inputs(spark, sf_dir).readings.select(
        "event_id", rk.normalise_score_100("pm25").alias("score"), rk.normalise_score_100("pm25", half_up=True).alias("page_score")
    )


@query(
    "B28_align_features",
    sql("readings", "SELECT event_id, round(no2,6) AS no2, CAST(NULL AS DOUBLE) AS humidity, round(pm25,6) AS pm25 FROM readings"),
)
def align_features(spark, sf_dir):
    out = cl.align_features(Inputs(spark, sf_dir).readings, ["event_id", "no2", "humidity", "pm25"])
    return out.withColumns({c: F.round(c, 6) for c in ("no2", "pm25")})


def _strict(name: str, table: str, bad: str) -> str:
    return f"SELECT '{name}' AS check_name, count(*) FILTER ({bad})=0 AS passed, count(*) FILTER ({bad}) AS violations FROM {table}"


def _lenient(name: str, table: str, column: str, lo, hi) -> str:
    bad = f"{column} NOT BETWEEN {lo} AND {hi}"
    return (
        f"SELECT '{name}', count({column})-count(*) FILTER ({bad})>=count({column})*0.99, count(*) FILTER ({bad}) FROM {table}"
    )


@query(
    "B29_dq_report",
    sql("factories readings_aqi reports", " UNION ALL ".join(
        [
            _strict("site_id_slash", "factories", "contains(factory_id,'/')"),
            _strict("site_industry_token", "factories", "NOT regexp_full_match(lower(trim(industry_type)),'[a-z0-9_]+')"),
            _strict("site_country", "factories", "country<>'India'"),
            _lenient("site_latitude_range", "factories", "latitude", 6, 38),
            _lenient("site_longitude_range", "factories", "longitude", 67, 98),
            "SELECT 'site_id_unique', count(*)=count(DISTINCT factory_id), count(*)-count(DISTINCT factory_id) FROM factories",
        ]
        + [
            _strict(f"reading_{c}_range", "readings_aqi", f"NOT coalesce({c} BETWEEN {lo} AND {hi},false)") for c, (lo, hi) in C.QUALITY_RANGES.items()
        ]
        + [
            _strict("reading_latitude_range", "readings_aqi", "NOT coalesce(station_lat BETWEEN -90 AND 90,false)"),
            _strict("reading_longitude_range", "readings_aqi", "NOT coalesce(station_lon BETWEEN -180 AND 180,false)"),
            _strict("reading_timestamp", "readings_aqi", "timestamp IS NULL"),
            _lenient("reading_aqi_range", "readings_aqi", "aqi_index", 0, 500),
            _strict("report_level", "reports", "risk_level NOT IN ('Low','Medium','High','Critical','Unknown')"),
            _strict("report_score_range", "reports", "composite_score NOT BETWEEN 0 AND 10"),
        ]
    )),
)
def dq_report(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return cl.quality_report(t.factories, t.readings_aqi, t.reports)


_SITE_ORACLE = (
    ", once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, osm_id ORDER BY seq) AS a FROM parsed) WHERE a=1), "
    "by_id AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY seq, city) AS b FROM once) WHERE b=1), "
    "by_place AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_even(latitude,3), round_even(longitude,3) ORDER BY seq, city) AS c FROM by_id) WHERE c=1), "
    "named AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(tagged, concat('Industrial_',osm_id)),'[^A-Za-z0-9\\s\\-&]',' ','g'),'\\s+',' ','g')) AS clean FROM by_place WHERE latitude BETWEEN 6 AND 38 AND longitude BETWEEN 67 AND 98), "
    f"cleaned AS (SELECT n.*, concat('OSM_',osm_id) AS factory_id, CASE WHEN clean<>'' THEN {title_sql('clean')} ELSE concat('Industrial_Facility_',osm_id) END AS factory_name, "
    f"{case_sql('industry_type', C.INDUSTRY_ALIASES, 'industry_type')} AS industry, coalesce(s.state,'Unknown') AS state FROM named n LEFT JOIN states s USING (city))"
)
SITE_EXTRA = "states AS " + values_sql([(c, s, lat, lon) for c, s, lat, lon in C.CITIES], "city, state, clat, clon", "t") + _SITE_ORACLE


@query(
    "B_clean_sites",
    sql("keyed", "SELECT factory_id, factory_name, industry AS industry_type, city, state, round(latitude,6) AS latitude FROM cleaned",
        COPIES + ", " + SITE_EXTRA),
)
def cleaned_sites(spark, sf_dir):
    out = clean_sites(raw_sites(Inputs(spark, sf_dir).site_elements), "2024-02-01")
    return out.select("factory_id", "factory_name", "industry_type", "city", "state", *r6("latitude"))
