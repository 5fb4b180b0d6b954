"""H: column functions, each run over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import aqi, risk as rk, trees as tr
from stackplume.functions import text as tx
from stackplume.functions.geo import bounding_box, haversine_km
from stackplume.operators.forecasting import time_encodings
from stackplume.plans.planting import plan_inputs, tree_plans
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.sqltext import (
    LEVEL, band_colour_sql, band_name_sql, band_sql, case_sql, epa10_sql, epa25_sql, epa_category_sql, even, half_up, hav, national_sql, num,
    quote, sql, title_sql,
)

BAND3 = "CASE WHEN {0} IS NULL THEN NULL WHEN {0}<=3 THEN 'Low' WHEN {0}<=6 THEN 'Medium' ELSE 'High' END"


@query(
    "H1_haversine_km",
    sql("readings", f"SELECT event_id, round({hav('station_lat', 'station_lon', '20.5937e0', '78.9629e0')},6) AS km FROM readings"),
)
def haversine(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    return r.select("event_id", F.round(haversine_km("station_lat", "station_lon", 20.5937, 78.9629), 6).alias("km"))


@query(
    "H2_bounding_box",
    sql("factories", "SELECT factory_id, round(latitude-25/111e0,6) AS min_lat, round(latitude+25/111e0,6) AS max_lat, "
        "round(longitude-25/(111e0*cos(radians(latitude))),6) AS min_lon, round(longitude+25/(111e0*cos(radians(latitude))),6) AS max_lon FROM factories"),
)
def box(spark, sf_dir):
    f = Inputs(spark, sf_dir).factories
    return f.withColumns(bounding_box("latitude", "longitude", 25.0)).select("factory_id", *r6("min_lat", "max_lat", "min_lon", "max_lon"))


@query(
    "H3_band_score",
    sql("readings", "SELECT event_id, " + ", ".join(f"round({band_sql(p, p)},6) AS {p}_score" for p in C.SCORED_POLLUTANTS) + " FROM readings"),
)
def band_score(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    return r.select("event_id", *[F.round(rk.band_score(p, p), 6).alias(f"{p}_score") for p in C.SCORED_POLLUTANTS])


@query(
    "H4_H5_H6_risk_bands",
    sql("readings", f"SELECT event_id, CASE WHEN s IS NULL THEN 'Unknown' ELSE {LEVEL.replace('composite_score', 's')} END AS four, "
        f"{BAND3.format('s')} AS three, CASE WHEN pm25>=70 THEN 'High' WHEN pm25>=40 THEN 'Moderate' WHEN pm25 IS NOT NULL THEN 'Low' END AS hundred "
        "FROM (SELECT event_id, pm25, pm25/20 AS s FROM readings)"),
)
def risk_bands(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.withColumn("s", F.col("pm25") / 20)
    return r.select(
        "event_id", rk.risk_band_4("s").alias("four"), rk.risk_band_3("s").alias("three"), rk.risk_band_100("pm25").alias("hundred")
    )


@query("H7_aqi_pm25_linear", sql("readings", f"SELECT event_id, round({national_sql('pm25')},6) AS aqi FROM readings"))
def aqi_national(spark, sf_dir):
    return Inputs(spark, sf_dir).readings.select("event_id", F.round(aqi.aqi_pm25_national(), 6).alias("aqi"))


@query(
    "H8_H9_H10_aqi_epa",
    sql("readings", f"SELECT event_id, {epa25_sql()} AS pm25_index, {epa10_sql()} AS pm10_index, {epa_category_sql(epa25_sql())} AS category FROM readings"),
)
def aqi_epa(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    return r.select(
        "event_id", aqi.aqi_pm25_epa().alias("pm25_index"), aqi.aqi_pm10_epa().alias("pm10_index"),
        aqi.aqi_category_epa(aqi.aqi_pm25_epa()).alias("category"),
    )


@query(
    "H11_aqi_band_national",
    sql("readings", f"SELECT event_id, {band_name_sql('so2')} AS band, {band_colour_sql('so2')} AS colour FROM readings"),
)
def aqi_band(spark, sf_dir):
    return Inputs(spark, sf_dir).readings.select(
        "event_id", aqi.aqi_band_national("so2").alias("band"), aqi.aqi_colour_national("so2").alias("colour")
    )


_KNOWN = "CASE WHEN event_id%5=0 THEN no2 END"


@query(
    "H12_aqi_coalesce",
    sql("readings", f"SELECT event_id, {even(f"coalesce({_KNOWN},{national_sql('pm25')},pm10/2,100e0)", 2)} AS aqi, "
        f"CASE WHEN event_id%5=0 THEN 'openaq' WHEN pm25 IS NOT NULL THEN 'openaq_calculated' WHEN pm10 IS NOT NULL THEN 'openaq_estimated' ELSE 'fallback' END AS source FROM readings"),
)
def aqi_coalesce(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.withColumn("aqi_index", F.when(F.col("event_id") % 5 == 0, F.col("no2")))
    return r.select("event_id", aqi.aqi_coalesced().alias("aqi"), aqi.aqi_source().alias("source"))


@query(
    "H13_aqi_from_pm",
    sql("readings", f"SELECT event_id, coalesce({epa25_sql()},{epa10_sql()},0) AS aqi, CASE WHEN pm25 IS NULL AND pm10 IS NULL THEN 'Unknown' ELSE "
        f"{epa_category_sql(f'coalesce({epa25_sql()},{epa10_sql()},0)')} END AS category FROM readings"),
)
def aqi_from_pm(spark, sf_dir):
    return Inputs(spark, sf_dir).readings.select(
        "event_id", aqi.aqi_from_pm().alias("aqi"), aqi.aqi_from_pm_category().alias("category")
    )


@query(
    "H14_H15_score_conversions",
    sql("readings", "SELECT event_id, "
        + ", ".join(f"round(least(greatest(pm25/20-1,0e0),10e0)/10*{num(m)},6) AS {p}_level" for p, m in C.SCORE_MAX_CONCENTRATION.items())
        + ", round(greatest(pm25/20*40,50e0),6) AS aqi FROM readings WHERE pm25 IS NOT NULL"),
)
def score_conversions(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.where("pm25 IS NOT NULL")
    return r.select(
        "event_id",
        *[F.round(aqi.score_to_concentration(F.col("pm25") / 20 - 1, p), 6).alias(f"{p}_level") for p in C.SCORE_MAX_CONCENTRATION],
        F.round(aqi.aqi_from_score(F.col("pm25") / 20), 6).alias("aqi"),
    )


@query(
    "H16_current_score",
    sql("readings", "SELECT event_id, round(CASE WHEN event_id%4=0 THEN o3/32 ELSE NULL END,6) AS stored, "
        "round(coalesce(CASE WHEN event_id%4=0 THEN o3/32 END, CASE WHEN (pm25-20)/15<0 THEN 0e0 WHEN (pm25-20)/15>10 THEN 10e0 ELSE (pm25-20)/15 END, 5e0),6) AS score FROM readings"),
)
def current_score(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.withColumn("stored", F.when(F.col("event_id") % 4 == 0, F.col("o3") / 32))
    return r.select("event_id", F.round("stored", 6).alias("stored"), F.round(rk.current_score("stored"), 6).alias("score"))


@query(
    "H17_reading_key",
    sql("readings", "SELECT event_id, CASE WHEN event_id%9=0 THEN '' ELSE concat(lower(trim(station_name)),'|',strftime(timestamp,'%Y-%m-%dT%H:%M:%S')) END AS key FROM readings"),
)
def reading_key(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    moment = F.when(F.col("event_id") % 9 != 0, F.col("timestamp").cast("string")).otherwise(F.lit("later"))
    return r.withColumn("moment", moment).withColumn("station", F.concat(F.lit("  "), F.upper("station_name"))).select(
        "event_id", tx.reading_key("station", "moment").alias("key")
    )


@query(
    "H18_time_encodings",
    "SELECT o_orderkey, CAST((year(o_orderdate)-2020)*12+month(o_orderdate) AS BIGINT) AS time_index, round((year(o_orderdate)-2020)/10e0,6) AS year_norm, "
    "round(sin(2*pi()*month(o_orderdate)/12),6)+0e0 AS month_sin, round(cos(2*pi()*month(o_orderdate)/12),6)+0e0 AS month_cos FROM orders",
)
def encodings(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    out = o.withColumns(time_encodings())
    return out.select(
        "o_orderkey", F.col("time_index").cast("bigint").alias("time_index"), *r6("year_norm"),
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("month_sin", "month_cos")],
    )


@query(
    "H19_class_probabilities",
    sql("readings", "SELECT event_id, round(lo/(lo+me+hi),6) AS prob_low, round(me/(lo+me+hi),6) AS prob_medium, round(hi/(lo+me+hi),6) AS prob_high FROM ("
        "SELECT event_id, CASE WHEN s<=3 THEN 1-(s/3)*0.3e0 ELSE 0e0 END AS lo, CASE WHEN s<=3 THEN (s/3)*0.3e0 WHEN s<=6 THEN 1-((s-3)/3)*0.4e0 ELSE 1-((s-6)/4)*0.3e0 END AS me, "
        "CASE WHEN s<=3 THEN 0e0 WHEN s<=6 THEN ((s-3)/3)*0.4e0 ELSE ((s-6)/4)*0.3e0 END AS hi FROM (SELECT event_id, so2/90e0 AS s FROM readings))"),
)
def class_probabilities(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.withColumn("s", F.col("so2") / 90)
    return r.withColumns(rk.class_probabilities("s")).select("event_id", *r6("prob_low", "prob_medium", "prob_high"))


def _advice_sql(texts: dict, level: str, title: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{quote(v)}'" for k, v in texts.items())
    return f"concat({title}, CASE {level} {cases} END)"


@query(
    "H20_recommendation_text",
    sql("scored", "SELECT factory_id, "
        + _advice_sql(C.SITE_ADVICE, "CASE WHEN risk_level IN ('High','Medium') THEN risk_level ELSE 'Low' END", title_sql("industry_type")) + " AS site_text, "
        + "CASE WHEN risk_level IN ('High','Medium','Low') THEN " + _advice_sql(C.SERVICE_ADVICE, "risk_level", title_sql("industry_type")) + " ELSE 'Unknown risk level' END AS service_text FROM scored"),
)
def recommendation_text(spark, sf_dir):
    return Inputs(spark, sf_dir).scored.select(
        "factory_id", rk.site_advice("risk_level", "industry_type").alias("site_text"),
        rk.service_advice("risk_level", "industry_type").alias("service_text"),
    )


@query(
    "H21_control_measures",
    sql("scored", "SELECT factory_id, " + case_sql("risk_level", {k: "; ".join(v) for k, v in C.CONTROL_MEASURES.items()}, "''") + " AS measures FROM scored"),
)
def control_measures(spark, sf_dir):
    return Inputs(spark, sf_dir).scored.select("factory_id", F.array_join(rk.control_measures("risk_level"), "; ").alias("measures"))


@query(
    "H22_report_summary",
    sql("scored", "SELECT factory_id, printf('%s is classified as %s risk with composite score %.2f. Top action: %s.', factory_name, risk_level, coalesce(composite_score,0e0), city) AS summary FROM scored"),
)
def report_summary(spark, sf_dir):
    return Inputs(spark, sf_dir).scored.select(
        "factory_id", rk.report_summary("factory_name", "risk_level", "composite_score", "city").alias("summary")
    )


@query(
    "H23_influence_radius",
    sql("scored", "SELECT factory_id, CASE risk_level WHEN 'Low' THEN 5000 WHEN 'Medium' THEN 10000 ELSE 15000 END AS radius_m FROM scored"),
)
def influence_radius(spark, sf_dir):
    return Inputs(spark, sf_dir).scored.select("factory_id", rk.influence_radius_m("risk_level").alias("radius_m"))


@query(
    "H24_H25_estimates",
    sql("readings", "SELECT event_id, "
        f"round(coalesce(CASE WHEN pm25<>0 THEN pm25 END, {half_up('20+s*1.2e0', 1)}),6) AS pm25, "
        f"round(coalesce(CASE WHEN pm10<>0 THEN pm10 END, {half_up('34+s*1.55e0', 1)}),6) AS pm10, "
        f"{half_up('16+s*0.75e0', 1)} AS no2, {half_up('7+s*0.5e0', 1)} AS so2, {half_up('0.45e0+s*0.045e0', 2)} AS co, {half_up('14+s*0.43e0', 1)} AS o3, "
        f"{half_up('1.3e0+s/22e0', 1)} AS radius_km, {half_up('0.24e0+s*0.014e0', 2)} AS population_m, {half_up('(no2-so2)/nullif(so2,0)*100', 1)} AS change "
        "FROM (SELECT *, CAST(event_id%101 AS DOUBLE) AS s FROM readings)"),
)
def estimates(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.withColumn("s", (F.col("event_id") % 101).cast("double"))
    levels = rk.estimated_levels("s", "pm25", "pm10")
    return r.select(
        "event_id", *[F.round(v, 6).alias(k) for k, v in levels.items()], *[v.alias(k) for k, v in rk.impact_extent("s").items()],
        rk.forecast_change_percent("so2", "no2").alias("change"),
    )


def _tree_ctes() -> str:
    conc = ", ".join(f"least(greatest({p}_score,0e0),10e0)/10*{num(C.SCORE_MAX_CONCENTRATION[p])} AS c_{p}" for p in C.POLLUTANTS)
    trees = ", ".join(
        f"greatest(c_{p}-greatest(c_{p}*scale,0e0),0e0)*(area*1000000)/{num(C.TREE_UPTAKE[p] * 100.0 * (1_000_000 if p in ('no2', 'so2', 'co') else 1))} AS t_{p}"
        for p in ("pm25", "pm10", "no2", "so2", "co")
    )
    chosen = "CASE dominant " + " ".join(f"WHEN '{p}' THEN t_{p}" for p in ("pm25", "pm10", "no2", "so2", "co")) + " END"
    largest = "greatest(" + ", ".join(f"CASE WHEN t_{p}>0 THEN t_{p} END" for p in ("pm25", "pm10", "no2", "so2", "co")) + ")"
    rate = case_sql("dominant", C.AQI_DROP_PER_1000, "3e0")
    return (
        f"inputs AS (SELECT factory_id, city, CASE WHEN composite_score=0 THEN 5e0 ELSE composite_score END AS score, dominant_pollutant AS dominant, {conc} FROM reports), "
        "staged AS (SELECT *, greatest(score*40,50e0) AS aqi, least(1+score*0.2e0,5e0) AS radius FROM inputs), "
        "goals AS (SELECT *, CASE WHEN aqi>400 THEN 300e0 WHEN aqi>300 THEN 200e0 WHEN aqi>200 THEN 100e0 ELSE 50e0 END AS goal, pi()*(radius*radius) AS area FROM staged), "
        "scaled AS (SELECT *, goal/greatest(aqi,1e0) AS scale FROM goals), "
        f"counted AS (SELECT *, {trees} FROM scaled), "
        f"based AS (SELECT *, greatest(CAST(ceil(CASE WHEN {chosen}>0 THEN {chosen} ELSE coalesce({largest},0e0) END) AS BIGINT),1) AS base FROM counted), "
        "tiers AS (SELECT *, CAST(ceil(base*1e0) AS BIGINT) AS minimum_trees, CAST(ceil(base*1.2e0) AS BIGINT) AS recommended_trees, CAST(ceil(base*1.5e0) AS BIGINT) AS optimal_trees FROM based), "
        f"sized AS (SELECT *, recommended_trees*100e0/10000 AS hectares, recommended_trees*0.022e0 AS co2, (recommended_trees/1000e0)*{rate} AS drop_points, {rate} AS rate FROM tiers), "
        "plans AS (SELECT *, CASE WHEN hectares>0 AND recommended_trees>(hectares*10000)/100e0 THEN 'Low' WHEN recommended_trees<500 THEN 'High' WHEN recommended_trees<2000 THEN 'Medium' ELSE 'Low' END AS feasibility FROM sized)"
    )


TREES = _tree_ctes()
_TREE_NAMES = ("pm25", "pm10", "no2", "so2", "co")


def _plans(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return tree_plans(plan_inputs(t.factories, t.reports))


@query(
    "H30_H31_target_and_radius",
    sql("reports", "SELECT factory_id, round(aqi,6) AS current_aqi, goal AS target_aqi, round(radius,6) AS impact_radius_km FROM plans", TREES),
)
def target_and_radius(spark, sf_dir):
    return _plans(spark, sf_dir).select("factory_id", *r6("current_aqi"), "target_aqi", *r6("impact_radius_km"))


@query(
    "H32_H33_H34_tree_counts",
    sql("reports", "SELECT factory_id, minimum_trees, recommended_trees, optimal_trees, "
        + ", ".join(f"CAST(ceil(t_{p}) AS BIGINT) AS {p}_trees" for p in _TREE_NAMES) + " FROM plans", TREES),
)
def tree_counts(spark, sf_dir):
    return _plans(spark, sf_dir).select(
        "factory_id", "minimum_trees", "recommended_trees", "optimal_trees", *[f"{p}_trees" for p in _TREE_NAMES]
    )


@query(
    "H35_H36_plan_metrics",
    sql("reports", "SELECT factory_id, " + even("hectares", 4) + " AS planting_area_hectares, " + even("co2", 4) + " AS annual_co2_offset_tons, "
        + even("drop_points", 2) + " AS estimated_aqi_reduction, feasibility FROM plans", TREES),
)
def plan_metrics(spark, sf_dir):
    return _plans(spark, sf_dir).select(
        "factory_id", "planting_area_hectares", "annual_co2_offset_tons", "estimated_aqi_reduction", "feasibility"
    )


@query(
    "H36_feasibility_by_count",
    sql("readings", "SELECT event_id, CASE WHEN area>0 AND n>(area*10000)/100e0 THEN 'Low' WHEN n<500 THEN 'High' WHEN n<2000 THEN 'Medium' ELSE 'Low' END AS feasibility FROM "
        "(SELECT event_id, event_id%3000+1 AS n, (event_id%3000+1)*100e0/10000 AS area FROM readings)"),
)
def feasibility_by_count(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.withColumn("n", F.col("event_id") % 3000 + 1)
    return r.select("event_id", tr.feasibility("n", tr.planting_hectares("n")).alias("feasibility"))


@query(
    "H37_plan_notes",
    sql("reports", "SELECT factory_id, concat_ws(' / ', printf('Current AQI %d → targeting %d (%s band).', CAST(round_even(aqi,0) AS BIGINT), CAST(goal AS BIGINT), "
        + band_name_sql("goal") + "), printf('Impact zone radius: %.1f km (%.1f km² total area).', radius, area), "
        "printf('Recommended planting: %d trees across %.2f ha (at %d trees/ha density).', recommended_trees, hectares, 1000), "
        "printf('Annual CO₂ sequestration: %.1f t CO₂ (22.0 kg/tree/year at maturity).', co2), "
        "printf('Estimated AQI improvement after 5-year maturity: %.1f AQI points.', drop_points), "
        "printf('Dominant pollutant: %s — trees reduce %.1f AQI pts per 1 000 trees.', upper(dominant), rate), "
        "printf('Feasibility: %s (%s).', feasibility, CASE WHEN minimum_trees<500 THEN '< 500 trees — highly practical' WHEN minimum_trees<2000 "
        "THEN '500–2 000 trees — medium-scale greening programme' ELSE '> 2 000 trees — large-scale urban forestry required' END)) AS notes FROM plans", TREES),
)
def plan_notes(spark, sf_dir):
    return _plans(spark, sf_dir).select("factory_id", F.array_join("notes", " / ").alias("notes"))


@query(
    "H38_extract_plan_inputs",
    sql("reports", "SELECT factory_id, round(score,6) AS composite_score, dominant AS dominant_pollutant, "
        + ", ".join(f"round(c_{p},6) AS {p}" for p in C.POLLUTANTS) + " FROM plans", TREES),
)
def extract_inputs(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return plan_inputs(t.factories, t.reports).select("factory_id", *r6("composite_score"), "dominant_pollutant", *r6(*C.POLLUTANTS))
