"""The whole jobs with their stored tables, and committed appends, each read back from its folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import learning as ln
from stackplume.plans import jobs
from stackplume.sources import committed
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.queries_cleaning import SITE_EXTRA
from stackplume.testbed.queries_jobs import ADVICE_SQL, _CLEAN
from stackplume.testbed.queries_sources import COPIES, scratch
from stackplume.testbed.sqltext import even, r6 as s6, sql

TARGETS = ["Pune", "Delhi", "Nashik"]
GENERATED_AT = "2024-02-01T00:00:00+00:00"


@query(
    "P1_site_job_counts",
    sql("keyed", "SELECT (SELECT count(*) FROM (SELECT DISTINCT city, osm_id FROM parsed)) AS raw_rows, count(*) AS cleaned_rows, count(*) AS processed_rows, "
        "count(DISTINCT city) AS cities, string_agg(DISTINCT industry, ',' ORDER BY industry) AS industries FROM cleaned", COPIES + ", " + SITE_EXTRA),
)
def site_job(spark, sf_dir):
    return jobs.collect_sites(Inputs(spark, sf_dir).site_elements, scratch(spark), "2024-02-01", form="csv").counts


_LIVE = (
    "wide AS (SELECT row_number() OVER (ORDER BY station_name, timestamp) AS event_id, 'live' AS source, * FROM (SELECT station_name, timestamp, "
    "arg_min(city,seq) AS city, arg_min_null(station_lat,seq) AS station_lat, arg_min_null(station_lon,seq) AS station_lon, "
    + ", ".join(f"arg_max_null(value,seq) FILTER (parameter='{p}') AS {p}" for p in C.POLLUTANTS)
    + " FROM measurements WHERE event_id%50 NOT IN (7,8) AND city IN (SELECT city FROM factories) GROUP BY station_name, timestamp)), "
    + _CLEAN.replace("readings_dup", "wide").replace("SELECT event_id, station_name, city,", "SELECT event_id, station_name, timestamp, city,").replace(
        "SELECT r.event_id, r.city,", "SELECT r.station_name, r.timestamp, r.city,")
)


@query(
    "P2_reading_job",
    sql("measurements site_distance factories", "SELECT station_name, strftime(timestamp,'%Y-%m-%d %H:%M:%S.%f') AS timestamp, city, 'live' AS source, "
        "round(nearest_factory_distance_km,6) AS km, "
        + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM filled)),6) AS {c}" for c in [*C.POLLUTANTS, "aqi_index"]) + " FROM filled", _LIVE),
)
def reading_job(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    landed = {"live": t.measurement_payloads, "open_data": t.open_records, "backfill": t.backfill}
    clean = jobs.collect_readings(landed, t.factories, scratch(spark), TARGETS).clean
    return clean.select(
        "station_name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "city", "source",
        F.round("nearest_factory_distance_km", 6).alias("km"), *r6(*C.POLLUTANTS, "aqi_index"),
    )


_SEEN = " AND NOT EXISTS (SELECT 1 FROM readings r WHERE event_id%3=0 AND lower(trim(r.station_name))=lower(trim(b.station_name)) AND date_trunc('second',r.timestamp)=date_trunc('second',b.timestamp))"


@query(
    "P2_backfill_rows",
    sql("readings", "SELECT event_id, city, round(CASE WHEN event_id%13<>0 THEN pm25 END,6) AS pm25 FROM (SELECT event_id, timestamp, pm25, city, "
        "CASE WHEN event_id%8=0 THEN concat('New ',station_name) ELSE concat(' ',upper(station_name),' ') END AS station_name FROM readings "
        "WHERE event_id%4=0 AND event_id%52<>8) b WHERE city IN ('Pune','Delhi')" + _SEEN),
)
def backfill_rows(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    known = t.readings.where("event_id % 3 = 0")
    return jobs.source_rows("backfill", t.backfill, t.factories, TARGETS, known).select("event_id", "city", *r6("pm25"))


@query(
    "P3_dataset_job",
    sql("split", "SELECT event_id, factory_id, season, split, round(pollution_impact_score,6) AS pollution_impact_score, round(r30,6) AS rolling_avg_pm25_30d FROM split"),
)
def dataset_job(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = jobs.prepare_dataset(t.readings, t.factories, scratch(spark))
    return out.select("event_id", "factory_id", "season", "split", *r6("pollution_impact_score", "rolling_avg_pm25_30d"))


@query(
    "P6_report_job",
    sql("reports", "SELECT factory_id, immediate_actions, short_term_actions, long_term_actions, summary, " + even("composite_score", 4) + " AS composite_score FROM reports"),
)
def report_job(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    folder = scratch(spark)
    jobs.store_recommendations(t.factories, t.near_city, folder, GENERATED_AT)
    actions = ["immediate_actions", "short_term_actions", "long_term_actions"]
    flat = spark.read.option("header", True).csv(f"{folder}/csv").fillna("", actions)
    return flat.select("factory_id", *actions, "summary", F.col("composite_score").cast("double").alias("composite_score"))


@query(
    "P6_report_job_critical",
    sql("reports", "SELECT factory_name, risk_level, round(composite_score,6) AS composite_score, top_action FROM (SELECT * FROM reports ORDER BY composite_score DESC, factory_id LIMIT 10)"),
)
def report_job_critical(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = jobs.store_recommendations(t.factories, t.near_city, scratch(spark), GENERATED_AT).critical
    return out.select("factory_name", "risk_level", *r6("composite_score"), "top_action")


@query(
    "P7_advice_job",
    sql("advice", "SELECT factory_id, risk_level, " + s6("pollution_impact_score latest_pm25 latest_pm10") + f", {ADVICE_SQL} AS recommendation FROM advice"),
)
def advice_job(spark, sf_dir):
    out = jobs.store_ranked_advice(Inputs(spark, sf_dir).dataset, scratch(spark))
    return out.select("factory_id", "risk_level", *r6("pollution_impact_score", "latest_pm25", "latest_pm10"), "recommendation")


@query(
    "P14_model_class_distribution",
    sql("split", "SELECT CASE WHEN pollution_impact_score<=3 THEN 'Low' WHEN pollution_impact_score<=6 THEN 'Medium' ELSE 'High' END AS label, count(*) AS true_rows "
        "FROM split WHERE split='test' GROUP BY ALL"),
)
def model_distribution(spark, sf_dir):
    data = Inputs(spark, sf_dir).ml_dataset
    usable = ln.fill_modes(data.where(f"{ln.TARGET} IS NOT NULL"), ln.CATEGORICAL_FEATURES)
    model = ln.fit(usable.where("split IN ('train', 'val')"), ln.random_forest())
    tables = jobs.evaluate_model(model, usable)
    return tables["distribution"].where("true_rows > 0").select("label", F.col("true_rows").cast("bigint").alias("true_rows"))


_NEW = "new_sites AS (SELECT factory_id, k AS seq FROM keyed UNION ALL SELECT factory_id, k+1000000 FROM keyed WHERE k%3=0)"


@query(
    "A13_committed_insert",
    sql("keyed", "SELECT factory_id, k AS seq, CASE WHEN industry_type='steel' THEN 'first' ELSE 'second' END AS batch FROM keyed"),
)
def committed_insert(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites
    path = scratch(spark)
    first = k.where("industry_type = 'steel'").select("factory_id", F.col("k").alias("seq"))
    again = F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1_000_000))).otherwise(F.array(F.lit(0)))
    second = k.select("factory_id", "k", F.explode(again).alias("shift")).select("factory_id", (F.col("k") + F.col("shift")).alias("seq"))
    committed.insert_sites(path, first, "first", ["seq"])
    for _ in range(2):
        # A repeated batch changes nothing.
        done = committed.insert_sites(path, second, "second", ["seq"])
    return done.table


@query(
    "A14_committed_append",
    sql("readings factories", "SELECT city, event_id, 'b1' AS batch FROM readings WHERE city IN (SELECT city FROM factories)"),
)
def committed_append(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    rows = t.readings.select("city", "event_id")
    return committed.insert_recommendations(scratch(spark), rows, "b1", t.factories, "city").table
