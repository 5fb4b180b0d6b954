"""P: the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import reports as rp
from stackplume.plans import air_quality, features, mapping, planting, readings as rd, scoring, serving, sites
from stackplume.plans.training import evaluation_tables
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.queries_aggregates import CLASS_METRICS, CLASSES, scored_pairs
from stackplume.testbed.queries_cleaning import SITE_EXTRA
from stackplume.testbed.queries_scalars import TREES
from stackplume.testbed.queries_sources import COPIES
from stackplume.testbed.sqltext import (
    band_name_sql, epa10_sql, epa25_sql, epa_category_sql, even, hav, national_sql, num, quote, r6 as s6, sql, title_sql,
)

PS = " ".join(C.POLLUTANTS)
SCORES = " ".join(f"{p}_score" for p in C.SCORED_POLLUTANTS)

_SITE_CLUSTERS = (
    f", pairs AS (SELECT a.factory_id AS a, b.factory_id AS b FROM cleaned a JOIN cleaned b ON {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}<=radians(0.05e0)*6371), "
    "cores AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*)>=2), "
    "links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)), "
    "reach AS (SELECT id AS a, id AS b FROM cores UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a=reach.b), "
    "numbered AS (SELECT a AS id, dense_rank() OVER (ORDER BY min(b))-1 AS cluster FROM reach GROUP BY a)"
)


@query(
    "P1_build_sites",
    sql("keyed", "SELECT c.factory_id, factory_name, industry AS industry_type, c.city, c.state, "
        f"CASE WHEN s.clat IS NULL THEN 'unknown' WHEN {hav('latitude', 'longitude', 's.clat', 's.clon')}<15 THEN 'urban' WHEN {hav('latitude', 'longitude', 's.clat', 's.clon')}<=40 THEN 'peri-urban' ELSE 'rural' END AS urban_rural, "
        "CASE WHEN industry IN ('chemical','steel','power','pharmaceutical','cement') THEN 'High' WHEN industry IN ('manufacturing','automotive','paper','food_processing') THEN 'Medium' ELSE 'Low' END AS pollution_risk_category, "
        "CAST(coalesce(n.cluster,-1) AS BIGINT) AS cluster_id FROM cleaned c LEFT JOIN states s ON s.city=c.city LEFT JOIN numbered n ON n.id=c.factory_id",
        COPIES + ", " + SITE_EXTRA + _SITE_CLUSTERS),
)
def build_sites(spark, sf_dir):
    out = sites.build_sites(Inputs(spark, sf_dir).site_elements, "2024-02-01")
    return out.select(
        "factory_id", "factory_name", "industry_type", "city", "state", "urban_rural", "pollution_risk_category", "cluster_id"
    )


_CLEAN = (
    "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_name, timestamp, source ORDER BY event_id) AS rn FROM readings_dup) WHERE rn=1), "
    "near AS (SELECT o.*, CASE WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN (pm25+pm10)/2 ELSE coalesce(pm25,pm10) END AS aqi_index, s.d AS nearest_factory_distance_km "
    "FROM once o JOIN site_distance s USING (station_lat, station_lon, city) WHERE s.d<=50), "
    "clipped AS (SELECT event_id, station_name, city, aqi_index, nearest_factory_distance_km, "
    + ", ".join(f"CASE WHEN {c}<{num(lo)} THEN {num(lo)} WHEN {c}>{num(hi)} THEN {num(hi)} ELSE {c} END AS {c}" for c, (lo, hi) in C.VALID_RANGES.items())
    + " FROM near), filled AS (SELECT r.event_id, r.city, r.nearest_factory_distance_km, "
    + ", ".join(f"coalesce(r.{c}, m.{c}) AS {c}" for c in [*C.POLLUTANTS, "aqi_index"]) + " FROM clipped r LEFT JOIN (SELECT station_name, "
    + ", ".join(f"median({c}) AS {c}" for c in [*C.POLLUTANTS, "aqi_index"]) + " FROM clipped GROUP BY station_name) m USING (station_name))"
)


@query(
    "P2_build_readings",
    sql("readings_dup site_distance", "SELECT event_id, city, round(nearest_factory_distance_km,6) AS km, "
        + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM filled)),6) AS {c}" for c in [*C.POLLUTANTS, "aqi_index"]) + " FROM filled", _CLEAN),
)
def build_readings(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = rd.build_readings(t.readings_dup, t.factories, ["event_id"])
    return out.select("event_id", "city", F.round("nearest_factory_distance_km", 6).alias("km"), *r6(*C.POLLUTANTS, "aqi_index"))


@query(
    "P2_readings_from_measurements",
    sql("measurements", "SELECT station_name, CAST(timestamp AS VARCHAR) AS timestamp, arg_min(city,seq) AS city, "
        + ", ".join(f"round(arg_max_null(value,seq) FILTER (parameter='{p}'),6) AS {p}" for p in C.POLLUTANTS)
        + " FROM measurements WHERE event_id%50 NOT IN (7,8) GROUP BY station_name, timestamp"),
)
def from_measurements(spark, sf_dir):
    out = rd.readings_from_measurements(Inputs(spark, sf_dir).measurement_payloads, requested_city="asked_city")
    return out.select("station_name", "timestamp", "city", *r6(*C.POLLUTANTS))


@query(
    "P2_readings_from_open_records",
    sql("measurements", "SELECT station_name, strftime(timestamp,'%Y-%m-%d %H:%M:%S.%f') AS timestamp, "
        + ", ".join(f"round(arg_max_null(CASE WHEN event_id%13<>0 THEN value END,seq) FILTER (parameter='{p}'),6) AS {p}" for p in C.POLLUTANTS)
        + " FROM measurements WHERE event_id%50 NOT IN (7,8) GROUP BY station_name, timestamp"),
)
def from_open_records(spark, sf_dir):
    out = rd.readings_from_open_records(Inputs(spark, sf_dir).open_records)
    return out.select("station_name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), *r6(*C.POLLUTANTS))


@query(
    "P3_build_dataset",
    sql("split", "SELECT event_id, factory_id, season, pollution_spike_flag, industry_risk_weight, split, round(r7,6) AS rolling_avg_pm25_7d, round(r30,6) AS rolling_avg_pm25_30d, "
        "round(distance_to_nearest_station,6) AS km, round(pollution_impact_score,6) AS pollution_impact_score, 1e0 AS wind_direction_factor FROM split"),
)
def build_dataset(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = features.build_dataset(t.readings, t.factories)
    return out.select(
        "event_id", "factory_id", "season", "pollution_spike_flag", "industry_risk_weight", "split",
        *r6("rolling_avg_pm25_7d", "rolling_avg_pm25_30d"), F.round("distance_to_nearest_station", 6).alias("km"),
        *r6("pollution_impact_score"), "wind_direction_factor",
    )


@query(
    "P5_site_risk_scores",
    sql("scored_first", "SELECT factory_id, factory_name, industry_type, city, risk_level, dominant_pollutant, round(composite_score,6) AS composite_score, " + s6(SCORES) + " FROM scored_first"),
)
def site_risk_scores(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = scoring.site_risk_scores(t.factories, t.near_city)
    return out.select(
        "factory_id", "factory_name", "industry_type", "city", "risk_level", "dominant_pollutant", *r6("composite_score", *SCORES.split())
    )


@query(
    "P6_recommendations",
    sql("reports", "SELECT factory_id, risk_level, round(composite_score,6) AS composite_score, all_actions, n_actions AS actions, summary FROM reports"),
)
def recommendations(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = scoring.recommend(t.factories, t.near_city, "2024-02-01T00:00:00+00:00")
    return out.select(
        "factory_id", "risk_level", *r6("composite_score"), F.array_join(F.transform("recommendations", lambda a: a["action"]), " > ").alias("all_actions"),
        F.size("recommendations").cast("bigint").alias("actions"), "summary",
    )


_ADVICE = {
    "High": C.SITE_ADVICE["High"], "Medium": C.SITE_ADVICE["Medium"], "Low": C.SITE_ADVICE["Low"],
}
ADVICE_SQL = f"concat({title_sql('industry_type')}, CASE risk_level " + " ".join(f"WHEN '{k}' THEN '{quote(v)}'" for k, v in _ADVICE.items()) + " END)"


@query(
    "P7_ranked_advice",
    sql("advice", "SELECT factory_id, risk_level, " + s6("pollution_impact_score latest_pm25 latest_pm10") + f", {ADVICE_SQL} AS recommendation FROM advice"),
)
def ranked_advice(spark, sf_dir):
    out = scoring.ranked_advice(Inputs(spark, sf_dir).dataset)
    return out.select("factory_id", "risk_level", *r6("pollution_impact_score", "latest_pm25", "latest_pm10"), "recommendation")


@query(
    "P8_list_sites",
    sql("reports", "SELECT factory_id, city, risk_level, round(composite_score,6) AS composite_score, count(*) OVER () AS total FROM "
        f"(SELECT r.* FROM reports r WHERE lower(city) LIKE '%pu%' AND lower(industry_type) LIKE '%e%' AND {hav('18.5204e0', '73.8567e0', 'latitude', 'longitude')}<=30) ORDER BY factory_id LIMIT 20"),
)
def list_sites(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = serving.list_sites(t.factories, t.reports, 1, 20, city="PU", industry="e", centre=(18.5204, 73.8567), radius_km=30.0)
    return out.select("factory_id", "city", "risk_level", *r6("composite_score"), "total")


@query(
    "P8_list_sites_by_level",
    sql("reports", "SELECT factory_id, risk_level, (SELECT count(*) FROM reports WHERE risk_level='Medium') AS total FROM reports WHERE risk_level='Medium' ORDER BY factory_id LIMIT 10 OFFSET 10"),
)
def list_sites_by_level(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serving.list_sites(t.factories, t.reports, 2, 10, risk_level="medium").select("factory_id", "risk_level", "total")


_LISTED = (
    f"FROM readings WHERE lower(city) LIKE '%mum%' AND o3 IS NOT NULL AND timestamp>=TIMESTAMP '2024-01-03' AND timestamp<TIMESTAMP '2024-01-29' AND {hav('19.0760e0', '72.8777e0', 'station_lat', 'station_lon')}<=20"
)


@query("P9_list_readings", sql("readings", f"SELECT event_id, city, round(o3,6) AS o3, (SELECT count(*) {_LISTED}) AS total {_LISTED} ORDER BY timestamp, event_id LIMIT 50 OFFSET 50"))
def list_readings(spark, sf_dir):
    out = serving.list_readings(
        Inputs(spark, sf_dir).readings, 2, 50, city="mum", parameter="o3", start="2024-01-03", end="2024-01-28", centre=(19.0760, 72.8777), radius_km=20.0
    )
    return out.select("event_id", "city", *r6("o3"), "total")


@query(
    "P10_list_reports",
    sql("reports", "SELECT factory_id, risk_level, round(composite_score,6) AS composite_score, summary, (SELECT count(*) FROM reports WHERE risk_level='Medium' AND lower(city) LIKE '%e%') AS total FROM reports "
        "WHERE risk_level='Medium' AND lower(city) LIKE '%e%' ORDER BY reports.composite_score DESC, factory_id LIMIT 15"),
)
def list_reports(spark, sf_dir):
    out = serving.list_reports(Inputs(spark, sf_dir).reports, 1, 15, risk_level="Medium", city="E")
    return out.select("factory_id", "risk_level", *r6("composite_score"), "summary", "total")


@query(
    "P10_list_reports_by_pattern",
    sql("reports", "SELECT factory_id, city, count(*) OVER () AS total FROM reports WHERE regexp_matches(lower(city),'pune|delhi') ORDER BY reports.composite_score DESC, factory_id LIMIT 25"),
)
def list_reports_by_pattern(spark, sf_dir):
    return serving.list_reports(Inputs(spark, sf_dir).reports, 1, 25, city="Pune|Delhi").select("factory_id", "city", "total")


@query(
    "P11_tree_plans",
    sql("reports", "SELECT factory_id, city, dominant AS dominant_pollutant, round(aqi,6) AS current_aqi, goal AS target_aqi, minimum_trees, recommended_trees, optimal_trees, "
        + even("hectares", 4) + " AS planting_area_hectares, " + even("co2", 4) + " AS annual_co2_offset_tons, " + even("drop_points", 2) + " AS estimated_aqi_reduction, feasibility FROM plans", TREES),
)
def tree_plans(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = planting.tree_plans(planting.plan_inputs(t.factories, t.reports))
    return out.select(
        "factory_id", "city", "dominant_pollutant", *r6("current_aqi"), "target_aqi", "minimum_trees", "recommended_trees", "optimal_trees",
        "planting_area_hectares", "annual_co2_offset_tons", "estimated_aqi_reduction", "feasibility",
    )


_LIVE = TREES.replace("staged AS (SELECT *, greatest(score*40,50e0) AS aqi", "live AS (SELECT i.* REPLACE (" + ", ".join(
    f"coalesce(CASE WHEN i.city='Pune' THEN {num(40.0 + n)} END, c_{p}) AS c_{p}" for n, p in enumerate(C.POLLUTANTS)
) + ") FROM inputs i), staged AS (SELECT *, CASE WHEN city='Pune' THEN 320e0 ELSE greatest(score*40,50e0) END AS aqi").replace("FROM inputs), goals", "FROM live), goals").replace(
    "AS radius FROM inputs)", "AS radius FROM live)")


@query(
    "P11_tree_plans_live",
    sql("reports", "SELECT factory_id, round(aqi,6) AS current_aqi, goal AS target_aqi, recommended_trees, round(c_pm25,6) AS pm25, feasibility FROM plans", _LIVE),
)
def tree_plans_live(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    live = t.factories.where("city = 'Pune'").select(
        "factory_id", F.lit(320.0).alias("aqi"), *[F.lit(40.0 + n).alias(p) for n, p in enumerate(C.POLLUTANTS)]
    )
    out = planting.tree_plans(planting.plan_inputs(t.factories, t.reports), live)
    return out.select("factory_id", *r6("current_aqi"), "target_aqi", "recommended_trees", *r6("pm25"), "feasibility")


@query(
    "P12_heatmap_dataset",
    sql("readings_aqi", "SELECT round(station_lat,6) AS lat, round(station_lon,6) AS lon, round((coalesce(aqi_index,m)-lo)/(hi-lo),6) AS intensity FROM readings_aqi, "
        "(SELECT median(aqi_index) AS m, min(aqi_index) AS lo, max(aqi_index) AS hi FROM readings_aqi WHERE station_lat IS NOT NULL) WHERE station_lat IS NOT NULL"),
)
def heatmap_dataset(spark, sf_dir):
    return mapping.heatmap_tables(Inputs(spark, sf_dir).readings_aqi, ["event_id"])["points"].select(*r6("lat", "lon", "intensity"))


@query(
    "P12_city_labels",
    sql("readings_aqi", "SELECT round(median(station_lat),6) AS lat, round(median(station_lon),6) AS lon, printf('%s | AQI %.1f', city, avg(aqi_index)) AS label FROM readings_aqi "
        "WHERE aqi_index IS NOT NULL AND station_lat IS NOT NULL GROUP BY city ORDER BY avg(aqi_index) DESC, city LIMIT 10"),
)
def city_labels(spark, sf_dir):
    tables = mapping.heatmap_tables(Inputs(spark, sf_dir).readings_aqi, ["event_id"])
    return mapping.city_labels(tables["cities"]).select(*r6("lat", "lon"), "label")


_POINTS = "points AS (SELECT * FROM readings_aqi WHERE lower(city) LIKE '%a%' AND station_lat IS NOT NULL AND pm25 IS NOT NULL ORDER BY md5('42:'||event_id), event_id LIMIT 2000)"


@query(
    "P13_heatmap_query",
    sql("readings_aqi", "SELECT event_id, round(station_lat,6) AS lat, round(station_lon,6) AS lon, round(pm25,6) AS intensity FROM points", _POINTS),
)
def heatmap_query(spark, sf_dir):
    points, _ = serving.heatmap_query(Inputs(spark, sf_dir).readings_aqi, 2000, "pm25", city="a")
    return points.select("event_id", *r6("lat", "lon", "intensity"))


@query(
    "P13_heatmap_query_metadata",
    sql("readings_aqi", "SELECT (SELECT count(*) FROM readings_aqi WHERE lower(city) LIKE '%a%') AS row_count, count(*) AS returned_points, round(min(station_lat),6) AS min_lat, "
        "round(max(station_lat),6) AS max_lat, round(min(station_lon),6) AS min_lon, round(max(station_lon),6) AS max_lon FROM points", _POINTS),
)
def heatmap_query_metadata(spark, sf_dir):
    _, metadata = serving.heatmap_query(Inputs(spark, sf_dir).readings_aqi, 2000, "pm25", city="a")
    return metadata.select("row_count", "returned_points", *r6("min_lat", "max_lat", "min_lon", "max_lon"))


@query("P14_evaluate_classifier", sql("readings", CLASS_METRICS, CLASSES))
def evaluate_classifier(spark, sf_dir):
    return evaluation_tables(scored_pairs(spark, sf_dir))["metrics"].select("label", *r6("precision", "recall", "f1"), "support")


@query(
    "P16_dashboard_sites",
    sql("advice", "SELECT factory_id, CASE risk_level WHEN 'Low' THEN 'green' WHEN 'Medium' THEN 'orange' ELSE 'red' END AS colour, "
        f"printf('%.2f',pollution_impact_score) AS score_text, {ADVICE_SQL} AS recommendation FROM advice"),
)
def dashboard_sites(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    tables = mapping.dashboard_tables(t.readings_aqi, scoring.ranked_advice(t.dataset), ["event_id"])
    return tables["sites"].select("factory_id", "colour", "score_text", "recommendation")


@query(
    "P16_dashboard_pins",
    sql("readings", "SELECT station_name, round(station_lat,6) AS station_lat, round(arg_min_null(pm25,event_id),6) AS pm25, arg_min(city,event_id) AS city FROM readings "
        "WHERE station_lat IS NOT NULL GROUP BY station_name, station_lat, station_lon"),
)
def dashboard_pins(spark, sf_dir):
    out = rp.station_pins(Inputs(spark, sf_dir).readings.where("station_lat IS NOT NULL"), ["event_id"])
    return out.select("station_name", *r6("station_lat", "pm25"), "city")


_NAT = f"coalesce(aqi_index,{national_sql('pm25')},pm10/2,100e0)"


@query(
    "P17_index_readings",
    sql("readings", f"SELECT event_id, round({national_sql('pm25')},6) AS aqi_national, {epa25_sql()} AS aqi_pm25_epa, {epa10_sql()} AS aqi_pm10_epa, "
        f"{even('coalesce(' + national_sql('pm25') + ',pm10/2,100e0)', 2)} AS aqi, coalesce({epa25_sql()},{epa10_sql()},0) AS aqi_from_pm, "
        f"CASE WHEN pm25 IS NULL AND pm10 IS NULL THEN 'Unknown' ELSE {epa_category_sql(f'coalesce({epa25_sql()},{epa10_sql()},0)')} END AS aqi_category, "
        f"{band_name_sql(even('coalesce(' + national_sql('pm25') + ',pm10/2,100e0)', 2))} AS aqi_band FROM readings"),
)
def index_readings(spark, sf_dir):
    unmeasured = Inputs(spark, sf_dir).readings.withColumn("aqi_index", F.lit(None).cast("double"))
    out = air_quality.index_readings(unmeasured)
    return out.select("event_id", *r6("aqi_national"), "aqi_pm25_epa", "aqi_pm10_epa", "aqi", "aqi_from_pm", "aqi_category", "aqi_band")


@query(
    "P17_city_day_index",
    sql("readings_aqi", "SELECT city, strftime(timestamp,'%Y-%m-%d') AS day, round(max(a),6) AS max_aqi, round(avg(a),9) AS mean_aqi, max(e) AS max_epa, count(*) AS readings FROM "
        f"(SELECT *, {even(_NAT, 2)} AS a, coalesce({epa25_sql()},{epa10_sql()},0) AS e FROM readings_aqi) GROUP BY ALL"),
)
def city_day_index(spark, sf_dir):
    out = air_quality.city_day_index(Inputs(spark, sf_dir).readings_aqi)
    return out.select("city", "day", *r6("max_aqi"), F.round("mean_aqi", 9).alias("mean_aqi"), "max_epa", "readings")


@query(
    "P18_plain_recommendations",
    sql("advice", "SELECT factory_id, city, risk_level, CAST(round_even(CASE WHEN pollution_impact_score<=10 THEN pollution_impact_score*10 ELSE pollution_impact_score END,0) AS BIGINT) AS pollution_score, "
        f"round(latest_pm25,6) AS latest_pm25, {ADVICE_SQL} AS recommendation FROM advice"),
)
def plain_recommendations(spark, sf_dir):
    out = serving.plain_recommendations(scoring.ranked_advice(Inputs(spark, sf_dir).dataset))
    return out.select("factory_id", "city", "risk_level", "pollution_score", *r6("latest_pm25"), "recommendation")


@query(
    "P18_plain_readings",
    sql("readings_aqi", "SELECT event_id, station_name, city, country, " + ", ".join(f"round(coalesce({c},0e0),6) AS {c}" for c in [*C.POLLUTANTS, "aqi_index", "station_lat", "station_lon"])
        + " FROM readings_aqi WHERE city='Chennai'"),
)
def plain_readings(spark, sf_dir):
    out = serving.plain_readings(Inputs(spark, sf_dir).readings_aqi, "chennai")
    return out.select("event_id", "station_name", "city", "country", *r6(*C.POLLUTANTS, "aqi_index", "station_lat", "station_lon"))


@query(
    "P18_plain_sites",
    sql("factories", "SELECT factory_id, factory_name, industry_type, city, state, country, " + s6("latitude longitude") + " FROM factories WHERE city='Pune'"),
)
def plain_sites(spark, sf_dir):
    out = serving.plain_sites(Inputs(spark, sf_dir).factories, "pune")
    return out.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(
    "P18_plain_recommendation_by_id",
    sql("advice", f"SELECT factory_id, city, risk_level, {ADVICE_SQL} AS recommendation FROM advice WHERE factory_id=(SELECT min(factory_id) FROM advice)"),
)
def plain_recommendation(spark, sf_dir):
    ranked = scoring.ranked_advice(Inputs(spark, sf_dir).dataset)
    first = ranked.agg(F.min("factory_id")).first()[0]
    return serving.plain_recommendation(ranked, first).select("factory_id", "city", "risk_level", "recommendation")


@query(
    "P16_dashboard_centre",
    sql("advice", "SELECT round(avg(latitude),6) AS lat, round(avg(longitude),6) AS lon FROM advice"),
)
def dashboard_centre(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return mapping.dashboard_tables(t.readings_aqi, scoring.ranked_advice(t.dataset), ["event_id"])["centre"].select(*r6("lat", "lon"))


@query("P14_confusion_matrix", sql("readings", "SELECT t AS true_class, count(*) FILTER (p='Low') AS pred_low, count(*) FILTER (p='Medium') AS pred_medium, "
       "count(*) FILTER (p='High') AS pred_high FROM classed GROUP BY t", CLASSES))
def classifier_confusion(spark, sf_dir):
    return evaluation_tables(scored_pairs(spark, sf_dir))["confusion"]
