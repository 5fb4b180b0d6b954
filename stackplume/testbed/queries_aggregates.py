"""D: aggregations and global statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import aqi
from stackplume.operators import aggregates as ag
from stackplume.operators.cleaning import validate_coords_country
from stackplume.operators.matching import add_risk
from stackplume.operators.reports import heatmap_points
from stackplume.plans import serving as sv
from stackplume.plans.training import classified
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.sqltext import LEVEL, band_sql, even, half_up, num, r6 as s6, sql

P7 = [*C.POLLUTANTS, "aqi_index"]


@query(
    "D1_impute_station_then_global_median",
    sql("readings_aqi", "SELECT event_id, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM filled)),6) AS {c}" for c in P7) + " FROM filled",
        "filled AS (SELECT r.event_id, " + ", ".join(f"coalesce(r.{c}, m.{c}) AS {c}" for c in P7) + " FROM readings_aqi r LEFT JOIN (SELECT station_name, "
        + ", ".join(f"median({c}) AS {c}" for c in P7) + " FROM readings_aqi GROUP BY station_name) m USING (station_name))"),
)
def impute(spark, sf_dir):
    return ag.impute_medians(Inputs(spark, sf_dir).readings_aqi).select("event_id", *r6(*P7))


_STATS = (
    f"SELECT city, {even('avg(pm25)', 2)} AS avg_pm25, {even('avg(pm10)', 2)} AS avg_pm10, {even('max(aqi_index)', 2)} AS max_aqi, count(*) AS reading_count FROM readings_aqi "
)


@query(
    "D2_city_stats",
    sql("readings_aqi", _STATS + "WHERE timestamp>=(SELECT max(timestamp) FROM readings_aqi)-INTERVAL 10 DAY GROUP BY city"),
)
def city_stats(spark, sf_dir):
    return sv.recent_city_stats(Inputs(spark, sf_dir).readings_aqi, days=10).orderBy("city")


@query("D2_city_stats_one_city", sql("readings_aqi", _STATS + "WHERE timestamp>=TIMESTAMP '2024-01-30'-INTERVAL 30 DAY AND city='Pune' GROUP BY city"))
def city_stats_one(spark, sf_dir):
    return sv.recent_city_stats(Inputs(spark, sf_dir).readings_aqi, days=30, as_of="2024-01-30", city="pun")


@query(
    "D3_site_impact_view",
    sql("advice", "SELECT factory_id, city, " + s6("pollution_impact_score latest_pm25 latest_pm10") + " FROM advice"),
)
def site_impact(spark, sf_dir):
    out = ag.site_impact_view(Inputs(spark, sf_dir).dataset)
    return out.select("factory_id", "city", *r6("pollution_impact_score", "latest_pm25", "latest_pm10"))


@query(
    "D4_city_and_national_means",
    sql("readings", "SELECT city, " + ", ".join(f"round(avg({p}),6) AS {p}" for p in C.POLLUTANTS) + " FROM readings GROUP BY city UNION ALL SELECT 'all', "
        + ", ".join(f"round(avg({p}),6)" for p in C.POLLUTANTS) + " FROM readings"),
)
def means(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    city = ag.column_means(r, C.POLLUTANTS, ["city"])
    return city.unionByName(ag.column_means(r, C.POLLUTANTS).withColumn("city", F.lit("all"))).select("city", *r6(*C.POLLUTANTS))


@query("D5_composite_target", sql("targets", "SELECT event_id, round(pollution_impact_score,6) AS pollution_impact_score FROM targets"))
def composite_target(spark, sf_dir):
    return Inputs(spark, sf_dir).dataset.select("event_id", *r6("pollution_impact_score"))


@query(
    "D6_zscore_spike",
    sql("readings", "SELECT event_id, coalesce(CASE WHEN (pm25-avg(pm25) OVER ())/stddev_samp(pm25) OVER ()>2.5 THEN 1 ELSE 0 END,0) AS pollution_spike_flag FROM readings"),
)
def spike(spark, sf_dir):
    return ag.spike_flag(Inputs(spark, sf_dir).readings).select("event_id", "pollution_spike_flag")


@query(
    "D7_minmax_intensity",
    sql("readings_aqi", "SELECT event_id, round((coalesce(aqi_index,m)-lo)/(hi-lo),6) AS intensity_normalized FROM readings_aqi, "
        "(SELECT median(aqi_index) AS m, min(aqi_index) AS lo, max(aqi_index) AS hi FROM readings_aqi)"),
)
def minmax(spark, sf_dir):
    return ag.minmax_intensity(Inputs(spark, sf_dir).readings_aqi).select("event_id", *r6("intensity_normalized"))


@query(
    "D8_top_polluted_cities",
    sql("readings_aqi", "SELECT city, round(avg(aqi_index),6) AS avg_aqi, round(median(station_lat),6) AS lat, round(median(station_lon),6) AS lon FROM readings_aqi "
        "WHERE aqi_index IS NOT NULL AND station_lat IS NOT NULL GROUP BY city ORDER BY avg(aqi_index) DESC, city LIMIT 5"),
)
def top_cities(spark, sf_dir):
    return ag.top_polluted_cities(Inputs(spark, sf_dir).readings_aqi, 5).select("city", *r6("avg_aqi", "lat", "lon"))


@query(
    "D9_map_center",
    sql("readings factories", "SELECT 'heatmap' AS map, round(median(station_lat),6) AS lat, round(median(station_lon),6) AS lon FROM readings UNION ALL "
        "SELECT 'dashboard', round(avg(latitude),6), round(avg(longitude),6) FROM factories"),
)
def center(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    one = ag.map_center(t.readings).withColumn("map", F.lit("heatmap"))
    return one.unionByName(ag.mean_center(t.factories).withColumn("map", F.lit("dashboard"))).select("map", *r6("lat", "lon"))


@query(
    "D10_site_quality_summary",
    sql("readings", "SELECT d AS dimension, v AS value, count(*) AS sites, " + even("100e0*count(station_lat)/count(*)", 2) + " AS coordinate_coverage FROM ("
        "SELECT 'total' AS d, NULL AS v, station_lat FROM readings UNION ALL SELECT 'city', city, station_lat FROM readings UNION ALL "
        "SELECT 'industry_type', source, station_lat FROM readings UNION ALL SELECT 'state', country, station_lat FROM readings) GROUP BY d, v"),
)
def quality_summary(spark, sf_dir):
    # Run over the readings, whose coordinates have gaps.
    r = Inputs(spark, sf_dir).readings.select(
        F.col("station_lat").alias("latitude"), F.col("station_lon").alias("longitude"), "city",
        F.col("source").alias("industry_type"), F.col("country").alias("state"),
    )
    return ag.site_quality_summary(r)


@query(
    "D11_report_stats",
    sql("reports", "SELECT count(*) AS total_factories, " + ", ".join(f"count(*) FILTER (risk_level='{n}') AS {n.lower()}" for n in ("Critical", "High", "Medium", "Low"))
        + ", max(generated_at) AS last_generated FROM reports"),
)
def report_stats(spark, sf_dir):
    return ag.report_stats(Inputs(spark, sf_dir).reports)


@query(
    "D11_top_pollutants",
    sql("reports", "SELECT dominant_pollutant AS pollutant, count(*) AS reports FROM reports GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
)
def top_pollutants(spark, sf_dir):
    return ag.top_pollutants(Inputs(spark, sf_dir).reports)


@query(
    "D12_pivot_measurements",
    sql("measurements", "SELECT station_name, CAST(timestamp AS VARCHAR) AS timestamp, round(arg_min_null(station_lat,seq),6) AS station_lat, arg_min(city,seq) AS city, "
        + ", ".join(f"round(arg_max_null(value,seq) FILTER (parameter='{p}'),6) AS {p}" for p in C.POLLUTANTS) + " FROM measurements GROUP BY station_name, timestamp"),
)
def pivot(spark, sf_dir):
    out = ag.pivot_measurements(Inputs(spark, sf_dir).measurements)
    return out.select("station_name", "timestamp", *r6("station_lat"), "city", *r6(*C.POLLUTANTS))


@query(
    "D13_latest_per_parameter",
    sql("measurements", "SELECT station_name, " + ", ".join(f"round(arg_min(value,seq) FILTER (parameter='{p}' AND value>=0),6) AS {p}" for p in C.POLLUTANTS)
        + ", CAST(NULL AS DOUBLE) AS aqi_index FROM (SELECT station_name, seq, parameter, CASE WHEN seq%5=0 THEN -value ELSE value END AS value FROM measurements) GROUP BY station_name"),
)
def latest(spark, sf_dir):
    m = Inputs(spark, sf_dir).measurements.withColumns(
        {
            "parameter": F.when(F.col("parameter") == "pm25", F.lit(" PM2.5")).otherwise(F.col("parameter")),
            "value": F.when(F.col("seq") % 5 == 0, -F.col("value")).otherwise(F.col("value")),
        }
    )
    out = ag.latest_per_parameter(m, ["station_name"])
    return out.select("station_name", *r6(*C.POLLUTANTS), "aqi_index")


@query("D14_naive_aqi", sql("readings_aqi", "SELECT event_id, round(aqi_index,6) AS aqi_index FROM readings_aqi"))
def naive(spark, sf_dir):
    return Inputs(spark, sf_dir).readings.select("event_id", F.round(aqi.naive_aqi(), 6).alias("aqi_index"))


_SCORED_READINGS = (
    "marked AS (SELECT event_id, "
    + ", ".join(f"{p}_score" for p in C.SCORED_POLLUTANTS)
    + ", CASE WHEN w>0 THEN s/w END AS composite_score FROM (SELECT *, "
    + "+".join(f"coalesce({num(C.RISK_WEIGHTS[p])}*{p}_score,0e0)" for p in C.SCORED_POLLUTANTS) + " AS s, "
    + "+".join(f"CASE WHEN {p}_score IS NULL THEN 0e0 ELSE {num(C.RISK_WEIGHTS[p])} END" for p in C.SCORED_POLLUTANTS) + " AS w FROM (SELECT event_id, "
    + ", ".join(band_sql(p, p) + f" AS {p}_score" for p in C.SCORED_POLLUTANTS)
    + " FROM readings)))"
)
_BEST = "greatest(" + ",".join(f"{p}_score" for p in C.SCORED_POLLUTANTS) + ")"


@query(
    "D15_D16_composite_and_dominant",
    sql("readings", f"SELECT event_id, {half_up('composite_score', 6)} AS composite_score, {LEVEL} AS risk_level, CASE "
        + " ".join(f"WHEN {p}_score={_BEST} THEN '{p}'" for p in C.SCORED_POLLUTANTS) + " ELSE 'Unknown' END AS dominant_pollutant FROM marked", _SCORED_READINGS),
)
def composite(spark, sf_dir):
    return add_risk(Inputs(spark, sf_dir).readings).select("event_id", *r6("composite_score"), "risk_level", "dominant_pollutant")


_YEARLY = (
    "yearly AS (SELECT factory_id, year, m AS predicted_score, least(greatest(m-0.5-0.8*s,0e0),10e0) AS confidence_lower, least(greatest(m+0.5+0.8*s,0e0),10e0) AS confidence_upper "
    "FROM (SELECT factory_id, year, avg(pollution_impact_score) AS m, stddev_pop(pollution_impact_score) AS s FROM monthly GROUP BY ALL))"
)


@query("D17_yearly_rollup", sql("monthly", "SELECT factory_id, year, " + s6("predicted_score confidence_lower confidence_upper") + " FROM yearly", _YEARLY))
def yearly(spark, sf_dir):
    out = ag.yearly_rollup(Inputs(spark, sf_dir).monthly, ["factory_id"], "pollution_impact_score")
    return out.select("factory_id", "year", *r6("predicted_score", "confidence_lower", "confidence_upper"))


_TRUTH = "pairs AS (SELECT event_id, no2/45e0 AS y_true, no2/45e0+(event_id*13%7-3)/10e0 AS y_pred FROM readings)"


def scored_pairs(spark, sf_dir):
    """A true score per reading and a prediction that is off by up to 0.3."""
    off = (F.pmod(F.col("event_id") * 13, F.lit(7)) - 3) / 10
    return Inputs(spark, sf_dir).readings.select("event_id", (F.col("no2") / 45).alias("y_true")).withColumn("y_pred", F.col("y_true") + off)


@query(
    "D18_regression_metrics",
    sql("readings", "SELECT round(sqrt(avg(power(y_true-y_pred,2))),6) AS rmse, round(avg(abs(y_true-y_pred)),6) AS mae, "
        "round(avg(CASE WHEN y_true<>0 THEN abs(y_true-y_pred)/abs(y_true) END),6) AS mape, "
        "round(1-sum(power(y_true-y_pred,2))/(var_pop(y_true)*count(*)),6) AS r2, count(*) AS rows FROM pairs", _TRUTH),
)
def regression(spark, sf_dir):
    pairs = scored_pairs(spark, sf_dir)
    # The percentage error of a true zero has no printable value; it is measured over the other rows.
    mape = ag.regression_metrics(pairs.where("y_true <> 0")).select("mape").scalar()
    return ag.regression_metrics(pairs).withColumn("mape", mape).select(*r6("rmse", "mae", "mape", "r2"), "rows")


CLASSES = (
    _TRUTH + ", classed AS (SELECT *, CASE WHEN y_true<=3 THEN 'Low' WHEN y_true<=6 THEN 'Medium' ELSE 'High' END AS t, CASE WHEN y_pred<=3 THEN 'Low' WHEN y_pred<=6 THEN 'Medium' ELSE 'High' END AS p FROM pairs), "
    "per AS (SELECT l.t AS label, hits/predicted AS precision, hits/support AS recall, 2*(hits/predicted)*(hits/support)/((hits/predicted)+(hits/support)) AS f1, support, hits FROM "
    "(SELECT t, CAST(count(*) AS DOUBLE) AS support, CAST(count(*) FILTER (t=p) AS DOUBLE) AS hits FROM classed GROUP BY t) l JOIN (SELECT p, CAST(count(*) AS DOUBLE) AS predicted FROM classed GROUP BY p) r ON r.p=l.t)"
)
CLASS_METRICS = (
    "SELECT label, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, CAST(support AS BIGINT) AS support FROM per UNION ALL "
    "SELECT 'accuracy', round(sum(hits)/sum(support),6), round(sum(hits)/sum(support),6), round(sum(hits)/sum(support),6), CAST(sum(support) AS BIGINT) FROM per UNION ALL "
    "SELECT 'macro avg', round(avg(precision),6), round(avg(recall),6), round(avg(f1),6), CAST(sum(support) AS BIGINT) FROM per UNION ALL "
    "SELECT 'weighted avg', round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6), round(sum(f1*support)/sum(support),6), CAST(sum(support) AS BIGINT) FROM per"
)


@query("D19_classification_metrics", sql("readings", CLASS_METRICS, CLASSES))
def classification(spark, sf_dir):
    out = ag.classification_metrics(classified(scored_pairs(spark, sf_dir)))
    return out.select("label", *r6("precision", "recall", "f1"), "support")


@query(
    "D19_class_distribution",
    sql("readings", "SELECT label, CAST(sum(a) AS BIGINT) AS true_rows, CAST(sum(b) AS BIGINT) AS predicted_rows FROM "
        "(SELECT t AS label, 1 AS a, 0 AS b FROM classed UNION ALL SELECT p, 0, 1 FROM classed) GROUP BY label", CLASSES),
)
def distribution(spark, sf_dir):
    return ag.class_distribution(classified(scored_pairs(spark, sf_dir)))


@query(
    "D20_confusion_matrix",
    sql("readings", "SELECT t AS true_class, count(*) FILTER (p='Low') AS pred_low, count(*) FILTER (p='Medium') AS pred_medium, count(*) FILTER (p='High') AS pred_high FROM classed GROUP BY t", CLASSES),
)
def confusion(spark, sf_dir):
    return ag.confusion_matrix(classified(scored_pairs(spark, sf_dir)), ["Low", "Medium", "High"])


_CONFIDENCE = (
    _TRUTH + ", shares AS (SELECT CASE WHEN s<=3 THEN greatest(1-(s/3)*0.3e0,(s/3)*0.3e0) WHEN s<=6 THEN greatest(1-((s-3)/3)*0.4e0,((s-3)/3)*0.4e0) "
    "ELSE greatest(1-((s-6)/4)*0.3e0,((s-6)/4)*0.3e0) END AS c FROM (SELECT y_pred AS s FROM pairs))"
)


@query(
    "D21_confidence_stats",
    sql("readings", "SELECT round(avg(c),6) AS mean, round(stddev_pop(c),6) AS std, round(min(c),6) AS min, round(max(c),6) AS max, round(median(c),6) AS median FROM shares", _CONFIDENCE),
)
def confidence(spark, sf_dir):
    return ag.confidence_stats(classified(scored_pairs(spark, sf_dir))).select(*r6("mean", "std", "min", "max", "median"))


@query(
    "D22_timestamp_range",
    sql("readings", "SELECT strftime(min(timestamp),'%Y-%m-%d')||' to '||strftime(max(timestamp),'%Y-%m-%d') AS timestamp_range FROM readings"),
)
def timestamp_range(spark, sf_dir):
    return ag.timestamp_range(Inputs(spark, sf_dir).readings)


@query(
    "D23_heatmap_metadata",
    sql("readings_aqi", "SELECT (SELECT count(*) FROM readings_aqi) AS row_count, count(*) AS returned_points, round(min(station_lat),6) AS min_lat, round(max(station_lat),6) AS max_lat, "
        "round(min(station_lon),6) AS min_lon, round(max(station_lon),6) AS max_lon FROM readings_aqi WHERE station_lat IS NOT NULL AND aqi_index IS NOT NULL"),
)
def heatmap_metadata(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings_aqi
    out = ag.heatmap_metadata(r, heatmap_points(r, "aqi_index"))
    return out.select("row_count", "returned_points", *r6("min_lat", "max_lat", "min_lon", "max_lon"))


@query(
    "D24_stage_counts",
    sql("factories", "SELECT count(*) AS processed_rows, count(DISTINCT city) AS cities, string_agg(DISTINCT industry_type, ',' ORDER BY industry_type) AS industries, "
        "(SELECT count(*) FROM factories) AS raw_rows, (SELECT count(*) FROM factories WHERE latitude BETWEEN 6 AND 38) AS cleaned_rows FROM factories WHERE latitude BETWEEN 6 AND 38"),
)
def stage_counts(spark, sf_dir):
    f = Inputs(spark, sf_dir).factories
    cleaned = validate_coords_country(f)
    return ag.stage_counts(f, cleaned, cleaned)


@query(
    "L13_analyze_trend",
    sql("monthly", "SELECT factory_id, round(f,6) AS first_score, round(l,6) AS last_score, CASE WHEN n<2 THEN 'stable' WHEN l-f>0.5 THEN 'increasing' WHEN l-f<-0.5 THEN 'decreasing' ELSE 'stable' END AS trend, "
        "CASE WHEN n<2 THEN 'stable' WHEN m>=7 OR l-f>1 THEN 'worsening' WHEN m<=4 OR l-f<-1 THEN 'improving' ELSE 'stable' END AS risk_trajectory FROM "
        "(SELECT factory_id, arg_min(predicted_score,year) AS f, arg_max(predicted_score,year) AS l, avg(predicted_score) AS m, count(*) AS n FROM yearly GROUP BY factory_id)", _YEARLY),
)
def trend(spark, sf_dir):
    yearly_scores = ag.yearly_rollup(Inputs(spark, sf_dir).monthly, ["factory_id"], "pollution_impact_score")
    out = ag.trend_summary(yearly_scores, ["factory_id"])
    return out.select("factory_id", *r6("first_score", "last_score"), "trend", "risk_trajectory")

