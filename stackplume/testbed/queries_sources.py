"""A: scans, payload parsers, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stackplume import schemas
from stackplume.operators.aggregates import dataset_info
from stackplume.session import ensure_checkpoint_dir
from stackplume.sources import payloads, scan, sinks
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.sqltext import even, r6 as s6, sql


def scratch(spark) -> str:
    """A new folder below the session's checkpoint folder (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"


@query("A1_scan_table", "SELECT s_suppkey, s_name, round(s_acctbal,6) AS s_acctbal FROM supplier")
def scan_table(spark, sf_dir):
    paths = [None, f"{sf_dir}/absent.parquet", f"{sf_dir}/absent.csv", f"{sf_dir}/supplier.parquet"]
    return scan.scan_table(spark, paths, schemas.FACTORIES).select("s_suppkey", "s_name", *r6("s_acctbal"))


@query("A1_scan_missing_is_empty", "SELECT event_id, CAST(NULL AS VARCHAR) AS factory_id FROM events WHERE false")
def scan_missing(spark, sf_dir):
    empty = scan.scan_table(spark, [f"{sf_dir}/absent.csv"], schemas.FACTORIES)
    return Inputs(spark, sf_dir).readings.join(empty, "city").select("event_id", "factory_id")


@query(
    "A3_first_nonempty_source",
    sql("readings", "SELECT event_id, 'open_data' AS source FROM readings WHERE source='view'"),
)
def first_nonempty(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    picked = scan.first_nonempty(
        [("live", r.where("source = 'nowhere'")), ("open_data", r.where("source = 'view'")), ("backfill", r)]
    )
    return picked.select("event_id", "source")


@query(
    "A3_union_first_nonempty",
    sql("readings", "SELECT event_id, 'backfill' AS source FROM readings"),
)
def union_first_nonempty(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    picked = scan.union_first_nonempty([("live", r.where("pm25 < -1")), ("backfill", r)])
    return picked.select("event_id", "source")


COPIES = """copies AS (SELECT *, 0 AS shift, 0 AS renumber FROM keyed UNION ALL SELECT *, 1000000, 0 FROM keyed WHERE k%10=0
 UNION ALL SELECT *, 2000000, 500000 FROM keyed WHERE k%15=0),
 parsed AS (SELECT k+shift AS seq, city, concat(CASE k%3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'rel_ation' END,'_',CAST(k+renumber AS VARCHAR)) AS osm_id,
 CASE k%7 WHEN 0 THEN concat('acme  STEEL-works (unit ',CAST(k AS VARCHAR),')') WHEN 1 THEN 'bharat_chem' WHEN 4 THEN '??' WHEN 5 THEN 'Textile''s 3m' END AS tagged,
 CASE k%7 WHEN 0 THEN 'steel' WHEN 1 THEN 'chemical' WHEN 2 THEN 'general_industrial' WHEN 3 THEN 'manufacturing' WHEN 4 THEN 'factory' WHEN 5 THEN 'textile' ELSE 'unknown' END AS industry_type,
 CASE k%7 WHEN 0 THEN concat('{"industrial":"Steel mill","landuse":"industrial","name":"acme  STEEL-works (unit ',CAST(k AS VARCHAR),')"}')
  WHEN 1 THEN '{"industrial":"refinery","operator":"bharat_chem"}' WHEN 2 THEN '{"landuse":"industrial"}' WHEN 3 THEN '{"man_made":"works","name":""}'
  WHEN 4 THEN '{"amenity":"factory","name":"??"}' WHEN 5 THEN '{"building":"industrial","industrial":"garment","name":"Textile''s 3m"}' ELSE '{}' END AS raw_tags,
 latitude, longitude FROM copies WHERE k%25<>0)"""


@query(
    "A4_parse_site_elements",
    sql("keyed", "SELECT seq, city, osm_id, coalesce(tagged, concat('Industrial_',osm_id)) AS factory_name, industry_type, raw_tags, "
        + s6("latitude longitude") + " FROM parsed", COPIES),
)
def parse_site_elements(spark, sf_dir):
    parsed = payloads.parse_site_elements(Inputs(spark, sf_dir).site_elements)
    return parsed.select("seq", "city", "osm_id", "factory_name", "industry_type", "raw_tags", *r6("latitude", "longitude"))


@query(
    "A5_parse_measurements",
    sql("measurements", "SELECT seq, station_name, CAST(timestamp AS VARCHAR) AS timestamp, parameter, city AS reading_city, 'India' AS country, "
        + s6("value station_lat station_lon") + " FROM measurements WHERE event_id%50 NOT IN (7,8)"),
)
def parse_measurements(spark, sf_dir):
    parsed = payloads.parse_measurements(Inputs(spark, sf_dir).measurement_payloads, requested_city="asked_city")
    return parsed.select(
        "seq", "station_name", "timestamp", "parameter", "reading_city", "country", *r6("value", "station_lat", "station_lon")
    )


@query(
    "A6_parse_open_records",
    sql("measurements", "SELECT seq, station_name, strftime(timestamp,'%Y-%m-%d %H:%M:%S.%f') AS timestamp, parameter, "
        "CASE WHEN event_id%13<>0 THEN round(value,6) END AS value, CASE WHEN event_id%6=0 THEN 'Somewhere' ELSE city END AS reading_city "
        "FROM measurements WHERE event_id%50 NOT IN (7,8)"),
)
def parse_open_records(spark, sf_dir):
    parsed = payloads.parse_open_records(Inputs(spark, sf_dir).open_records)
    return parsed.select(
        "seq", "station_name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "parameter",
        *r6("value"), "reading_city",
    )


_BACKFILL = """backfill AS (SELECT event_id, CASE WHEN event_id%8=0 THEN concat('New ',station_name) ELSE concat(' ',upper(station_name),' ') END AS station_name,
 timestamp, CASE WHEN event_id%13<>0 THEN pm25 END AS pm25, CASE WHEN event_id%13<>0 THEN pm10 END AS pm10, CASE WHEN event_id%13<>0 THEN o3 END AS o3,
 station_lat, station_lon, city FROM readings WHERE event_id%4=0 AND event_id%52<>8)"""


@query(
    "A7_scan_backfill",
    sql("readings", "SELECT event_id, station_name, strftime(timestamp,'%Y-%m-%d %H:%M:%S.%f') AS timestamp, city, 'India' AS country, "
        + s6("pm25 pm10 o3 station_lat station_lon") + ", CAST(NULL AS DOUBLE) AS co FROM backfill", _BACKFILL),
)
def scan_backfill(spark, sf_dir):
    wide = payloads.normalise_backfill(Inputs(spark, sf_dir).backfill)
    return wide.select(
        "event_id", "station_name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "city", "country",
        *r6("pm25", "pm10", "o3", "station_lat", "station_lon"), "co",
    )


@query(
    "A8_write_csv",
    sql("factories", "SELECT factory_id, factory_name, city, " + s6("latitude longitude") + " FROM factories"),
)
def write_csv(spark, sf_dir):
    path = scratch(spark)
    sinks.write_csv(Inputs(spark, sf_dir).factories, path)
    stored = spark.read.option("header", True).csv(path)
    return stored.select(
        "factory_id", "factory_name", "city", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("latitude", "longitude")]
    )


@query("A9_write_parquet", sql("readings", "SELECT event_id, city, " + s6("pm25 pm10") + " FROM readings"))
def write_parquet(spark, sf_dir):
    path = scratch(spark)
    sinks.write_parquet(Inputs(spark, sf_dir).readings, path, ["city"])
    return spark.read.parquet(path).select("event_id", "city", *r6("pm25", "pm10"))


@query(
    "A10_export_reports_json",
    sql("reports", "SELECT factory_id, risk_level, n_actions AS actions, top_action, round(composite_score,6) AS composite_score, "
        "round(so2_score,6) AS so2_score, (SELECT count(*) FROM reports) AS count FROM reports"),
)
def export_reports_json(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    path = scratch(spark)
    sinks.export_reports_json(t.reports, path)
    lines = spark.read.text(f"{path}/reports")
    number = lambda p: F.round(F.get_json_object("value", p).cast("double"), 6)
    return lines.select(
        F.get_json_object("value", "$.factory_id").alias("factory_id"),
        F.get_json_object("value", "$.risk_level").alias("risk_level"),
        F.json_array_length(F.get_json_object("value", "$.recommendations")).cast("bigint").alias("actions"),
        F.get_json_object("value", "$.recommendations[0].action").alias("top_action"),
        number("$.composite_score").alias("composite_score"),
        number("$.pollution_scores.so2_score").alias("so2_score"),
    ).withColumn("count", spark.read.json(f"{path}/count", "count bigint").scalar())


@query(
    "A11_export_reports_csv",
    sql("reports", "SELECT factory_id, risk_level, immediate_actions, monitoring_actions, summary, generated_at, "
        + even("composite_score", 4) + " AS composite_score FROM reports"),
)
def export_reports_csv(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    path = scratch(spark)
    sinks.export_reports_csv(t.reports, path)
    stored = spark.read.option("header", True).csv(path).fillna("", ["immediate_actions", "monitoring_actions"])
    return stored.select(
        "factory_id", "risk_level", "immediate_actions", "monitoring_actions", "summary", "generated_at",
        F.col("composite_score").cast("double").alias("composite_score"),
    )


@query(
    "A12_dataset_info",
    sql("factories readings", "SELECT 'factories' AS dataset, count(*) AS rows FROM factories UNION ALL SELECT 'pollution', count(*) FROM readings"),
)
def dataset_counts(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return dataset_info({"factories": t.factories, "pollution": t.readings})


_NEW_SITES = "new_sites AS (SELECT factory_id, k AS seq FROM keyed UNION ALL SELECT factory_id, k+1000000 FROM keyed WHERE k%3=0)"


@query(
    "A13_insert_if_absent",
    sql("keyed", "SELECT factory_id, seq, CASE WHEN factory_id IN (SELECT factory_id FROM keyed WHERE industry_type='steel') OR seq>=1000000 "
        "THEN 'conflict' ELSE 'inserted' END AS outcome FROM new_sites", _NEW_SITES),
)
def insert_if_absent(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites
    existing = k.where("industry_type = 'steel'")
    again = F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1_000_000))).otherwise(F.array(F.lit(0)))
    batch = k.select("factory_id", "k", F.explode(again).alias("shift")).select("factory_id", (F.col("k") + F.col("shift")).alias("seq"))
    accepted, conflicts = scan.insert_if_absent(existing, batch, "factory_id", ["seq"])
    return accepted.withColumn("outcome", F.lit("inserted")).unionByName(conflicts.withColumn("outcome", F.lit("conflict")))


@query(
    "A14_append_with_parent",
    sql("readings factories", "SELECT event_id, city, CASE WHEN city IN (SELECT city FROM factories) THEN 'appended' ELSE 'rejected' END AS outcome FROM readings"),
)
def append_with_parent(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    kept, rejected = scan.append_with_parent(t.readings.select("event_id", "city"), t.factories, "city")
    return kept.withColumn("outcome", F.lit("appended")).unionByName(rejected.withColumn("outcome", F.lit("rejected")))
