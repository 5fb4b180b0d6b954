"""J: actions, reports and their other forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import reports as rp
from stackplume.operators import rules as rl
from stackplume.plans.scoring import ranked_advice
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.sqltext import PRIORITY_RANK, band_colour_sql, band_name_sql, even, r6 as s6, sql

FIELDS = "category, priority, action, pollutant, estimated_reduction, cost_category, timeline"


@query("J1_apply_rules", sql("actions", f"SELECT factory_id, {FIELDS} FROM actions"))
def apply_rules(spark, sf_dir):
    return rl.apply_rules(Inputs(spark, sf_dir).scored)


@query(
    "J2_learned_category_to_action",
    sql("scored", "SELECT factory_id, 'ML Suggested' AS category, 'Short-term' AS priority, 'Apply data-driven intervention plan for category: '||c AS action, dominant_pollutant AS pollutant, "
        "'Data-driven estimate pending site audit' AS estimated_reduction, 'Medium' AS cost_category, '2-6 months' AS timeline FROM scored, (SELECT unnest(['Audit','SO2_Control']) AS c)"),
)
def learned(spark, sf_dir):
    names = F.array(F.lit("SO2_Control"), F.lit("Audit"), F.lit("SO2_Control"))
    s = Inputs(spark, sf_dir).scored
    return s.select("factory_id", F.explode(rl.learned_actions(names, F.col("dominant_pollutant"))).alias("a")).select(
        "factory_id", *[F.col(f"a.{f}").alias(f) for f in rl.ACTION_FIELDS]
    )


_BOTH = (
    "both_kinds AS (SELECT factory_id, category, priority, action, 'rule' AS origin FROM actions UNION ALL "
    "SELECT factory_id, 'ML Suggested', 'Short-term', 'Apply data-driven intervention plan for category: Audit', 'learned' FROM scored)"
)


def _both(spark, sf_dir):
    s = Inputs(spark, sf_dir).scored
    rule = rl.apply_rules(s).withColumn("origin", F.lit("rule"))
    learned_rows = s.select("factory_id", F.explode(rl.learned_actions(F.array(F.lit("Audit")), F.col("dominant_pollutant"))).alias("a")).select(
        "factory_id", *[F.col(f"a.{f}").alias(f) for f in rl.ACTION_FIELDS], F.lit("learned").alias("origin")
    )
    return rule.unionByName(learned_rows)


@query(
    "J3_merge_rank",
    sql("actions scored", f"SELECT factory_id, action, round(w,6) AS weight, row_number() OVER (PARTITION BY factory_id ORDER BY w DESC, rk, action) AS position FROM "
        f"(SELECT *, {PRIORITY_RANK} AS rk, CASE WHEN origin='rule' THEN 0.7e0 ELSE 0.3e0 END*(10-{PRIORITY_RANK}) AS w FROM both_kinds)", _BOTH),
)
def merge_rank(spark, sf_dir):
    return rl.merge_rank(_both(spark, sf_dir)).select("factory_id", "action", *r6("weight"), "position")


@query(
    "J4_dedupe_actions",
    sql("actions scored", "SELECT factory_id, category, priority, action, min(origin) AS origin FROM both_kinds GROUP BY factory_id, category, priority, action", _BOTH),
)
def dedupe_actions(spark, sf_dir):
    both = _both(spark, sf_dir)
    twice = both.unionByName(both.withColumn("origin", F.concat("origin", F.lit("_again"))))
    return rl.dedupe_actions(twice, ["origin"]).select("factory_id", "category", "priority", "action", "origin")


@query(
    "J5_assemble_report",
    sql("reports", "SELECT factory_id, risk_level, dominant_pollutant, all_actions, n_actions AS actions, summary, generated_at, round(composite_score,6) AS composite_score, "
        + ", ".join(f"round({p}_score,6) AS {p}_score" for p in C.SCORED_POLLUTANTS) + " FROM reports"),
)
def assemble(spark, sf_dir):
    r = Inputs(spark, sf_dir).reports
    return r.select(
        "factory_id", "risk_level", "dominant_pollutant",
        F.array_join(F.transform("recommendations", lambda a: a["action"]), " > ").alias("all_actions"),
        F.size("recommendations").cast("bigint").alias("actions"), "summary", "generated_at", *r6("composite_score"),
        *[F.round(f"pollution_scores.{p}_score", 6).alias(f"{p}_score") for p in C.SCORED_POLLUTANTS],
    )


@query(
    "J6_reports_to_summary",
    sql("reports", "SELECT factory_id, factory_name, industry_type, city, risk_level, round(composite_score,6) AS composite_score, dominant_pollutant, summary, generated_at FROM reports"),
)
def summaries(spark, sf_dir):
    return rp.reports_to_summary(Inputs(spark, sf_dir).reports).withColumn("composite_score", F.round("composite_score", 6))


@query(
    "J7_reports_to_flat",
    sql("reports", "SELECT factory_id, factory_name, industry_type, city, risk_level, " + even("composite_score", 4) + " AS composite_score, dominant_pollutant, immediate_actions, "
        "short_term_actions, long_term_actions, monitoring_actions, summary, generated_at FROM reports"),
)
def flat(spark, sf_dir):
    return rp.reports_to_flat(Inputs(spark, sf_dir).reports)


_LABEL_RULES = [("so2", "SO2_Control"), ("pm", "PM_Control"), ("no2", "NOx_Control"), ("co", "CO_Control"), ("o3", "O3_Control"), ("multiple", "Audit")]


@query(
    "J8_split_labels",
    sql("scored actions", "SELECT s.factory_id, " + ", ".join(
        f"CAST(EXISTS (SELECT 1 FROM actions a WHERE a.factory_id=s.factory_id AND a.condition='{c}') AS INTEGER) AS label_{n}" for c, n in _LABEL_RULES
    ) + " FROM scored s"),
)
def split_labels(spark, sf_dir):
    s = Inputs(spark, sf_dir).scored.withColumn("labels", rl.action_labels())
    return rl.split_labels(s, "labels", C.ACTION_LABELS).select("factory_id", *[f"label_{n}" for n in C.ACTION_LABELS])


@query(
    "J9_heatmap_points",
    sql("readings_aqi", "SELECT round(station_lat,6) AS lat, round(station_lon,6) AS lon, round(aqi_index,6) AS intensity FROM readings_aqi WHERE station_lat IS NOT NULL AND aqi_index IS NOT NULL"),
)
def heatmap_points(spark, sf_dir):
    return rp.heatmap_points(Inputs(spark, sf_dir).readings_aqi, "aqi_index").select(*r6("lat", "lon", "intensity"))


@query(
    "J10_points_to_geojson",
    sql("readings", "SELECT 'Feature' AS kind, round(station_lon,4) AS lon, round(station_lat,4) AS lat, round(least(no2/100,1e0),6) AS intensity FROM readings WHERE station_lat IS NOT NULL"),
)
def geojson(spark, sf_dir):
    features = rp.points_to_features(rp.heatmap_points(Inputs(spark, sf_dir).readings, "no2"))
    number = lambda path, n: F.round(F.get_json_object("feature", path).cast("double"), n)
    return features.select(
        F.get_json_object("feature", "$.type").alias("kind"),
        number("$.geometry.coordinates[0]", 4).alias("lon"), number("$.geometry.coordinates[1]", 4).alias("lat"),
        number("$.properties.intensity", 6).alias("intensity"),
    )


@query(
    "J11_station_markers",
    sql("readings_aqi", "SELECT round(station_lat,6) AS lat, round(station_lon,6) AS lon, station_name AS station, city, "
        f"CASE WHEN aqi_index IS NULL THEN 'Unknown' ELSE {band_name_sql('aqi_index')} END AS band, CASE WHEN aqi_index IS NULL THEN '#808080' ELSE {band_colour_sql('aqi_index')} END AS colour, "
        "CASE WHEN pm25 IS NULL THEN 'N/A' ELSE printf('%.2f',pm25) END AS pm25, strftime(timestamp,'%Y-%m-%d %H:%M:%S') AS timestamp, "
        "concat(station_name,' | AQI: ',CASE WHEN aqi_index IS NULL THEN 'N/A' ELSE printf('%.2f',aqi_index) END) AS tooltip FROM "
        "(SELECT *, row_number() OVER (PARTITION BY station_lat, station_lon ORDER BY event_id) AS rn FROM readings_aqi WHERE station_lat IS NOT NULL) WHERE rn=1"),
)
def station_markers(spark, sf_dir):
    out = rp.station_markers(Inputs(spark, sf_dir).readings_aqi, ["event_id"])
    return out.select(*r6("lat", "lon"), "station", "city", "band", "colour", "pm25", "timestamp", "tooltip")


@query(
    "J12_site_markers",
    sql("advice", "SELECT factory_id, " + s6("latitude longitude") + ", CASE risk_level WHEN 'Low' THEN 'green' WHEN 'Medium' THEN 'orange' ELSE 'red' END AS colour, "
        "CASE risk_level WHEN 'Low' THEN 5000 WHEN 'Medium' THEN 10000 ELSE 15000 END AS influence_radius_m, printf('%.2f',pollution_impact_score) AS score_text, risk_level FROM advice"),
)
def site_markers(spark, sf_dir):
    out = rp.site_markers(ranked_advice(Inputs(spark, sf_dir).dataset))
    return out.select("factory_id", *r6("latitude", "longitude"), "colour", "influence_radius_m", "score_text", "risk_level")

