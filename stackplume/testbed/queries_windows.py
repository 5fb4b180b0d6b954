"""E, F: windows, splits, sorting and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume.operators import aggregates as ag
from stackplume.operators import listing as ls
from stackplume.operators import nearest as nr
from stackplume.operators import reports as rp
from stackplume.operators import windows as wn
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.sqltext import r6 as s6, sql


def _rolling(spark, sf_dir, sizes):
    t = Inputs(spark, sf_dir)
    joined = nr.nearest_site_join(t.readings, t.factories)
    return wn.rolling_means(joined, "factory_id", "timestamp", "event_id", "pm25", sizes)


@query("E1_rolling_mean_rows_7", sql("features", "SELECT event_id, factory_id, round(r7,6) AS rolling_avg_pm25_7d FROM features"))
def rolling_7(spark, sf_dir):
    return _rolling(spark, sf_dir, {"rolling_avg_pm25_7d": 7}).select("event_id", "factory_id", *r6("rolling_avg_pm25_7d"))


@query("E2_rolling_mean_rows_30", sql("features", "SELECT event_id, factory_id, round(r30,6) AS rolling_avg_pm25_30d FROM features"))
def rolling_30(spark, sf_dir):
    return _rolling(spark, sf_dir, {"rolling_avg_pm25_30d": 30}).select("event_id", "factory_id", *r6("rolling_avg_pm25_30d"))


@query(
    "E3_E4_lag_features",
    sql("monthly", "SELECT factory_id, year, month, round(coalesce(lag(s,1) OVER w, s),6) AS score_lag_1, round(coalesce(lag(s,3) OVER w, s),6) AS score_lag_3, "
        "round(avg(s) OVER (PARTITION BY factory_id ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),6) AS score_rolling_mean_3 "
        "FROM (SELECT *, pollution_impact_score AS s FROM monthly) WINDOW w AS (PARTITION BY factory_id ORDER BY year, month)"),
)
def lag_features(spark, sf_dir):
    out = wn.lag_features(Inputs(spark, sf_dir).monthly, "factory_id", ["year", "month"], "pollution_impact_score")
    return out.select("factory_id", "year", "month", *r6("score_lag_1", "score_lag_3", "score_rolling_mean_3"))


@query(
    "E5_dedupe_first",
    sql("readings_dup", "SELECT station_name, strftime(timestamp,'%Y-%m-%d %H:%M:%S.%f') AS timestamp, source, min(event_id) AS event_id FROM readings_dup GROUP BY ALL"),
)
def dedupe_first(spark, sf_dir):
    first = wn.first_per_key(Inputs(spark, sf_dir).readings_dup, ["station_name", "timestamp", "source"], ["event_id"])
    return first.select("station_name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "source", "event_id")


@query("E6_quantile_bins", sql("binned", "SELECT event_id, CAST(target_bin AS BIGINT) AS target_bin FROM binned"))
def quantile_bins(spark, sf_dir):
    out = ag.quantile_bins(Inputs(spark, sf_dir).dataset, "pollution_impact_score", "target_bin")
    return out.select("event_id", F.col("target_bin").cast("bigint").alias("target_bin"))


@query(
    "E7_stratified_split",
    sql("readings", "SELECT event_id, CASE WHEN share<0.15 THEN 'test' WHEN share<0.15+0.15 THEN 'val' ELSE 'train' END AS split FROM (SELECT event_id, "
        "(row_number() OVER (PARTITION BY city ORDER BY md5('42:'||event_id), event_id)-1)/CAST(count(*) OVER (PARTITION BY city) AS DOUBLE) AS share FROM readings)"),
)
def stratified_split(spark, sf_dir):
    return wn.stratified_split(Inputs(spark, sf_dir).readings.select("event_id", "city"), "city", ["event_id"]).select("event_id", "split")


@query(
    "E8_time_split",
    sql("monthly", "SELECT factory_id, time_index, CASE WHEN time_index<=(SELECT max((year-2020)*12+month) FROM monthly)-6 THEN 'train' ELSE 'val' END AS split "
        "FROM (SELECT factory_id, (year-2020)*12+month AS time_index FROM monthly)"),
)
def time_split(spark, sf_dir):
    indexed = Inputs(spark, sf_dir).monthly.withColumn("time_index", (F.col("year") - 2020) * 12 + F.col("month"))
    return ag.time_split(indexed).select("factory_id", "time_index", "split")


@query(
    "F1_paginate",
    sql("readings", "SELECT event_id, round(pm25,6) AS pm25, (SELECT count(*) FROM readings WHERE pm25 IS NOT NULL) AS total FROM readings WHERE pm25 IS NOT NULL "
        "ORDER BY readings.pm25 DESC, event_id LIMIT 500 OFFSET 1000"),
)
def paginate(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings.where("pm25 IS NOT NULL")
    page = ls.paginate(r, 3, 500, [F.col("pm25").desc(), F.col("event_id")])
    return ls.with_total(page, r).select("event_id", *r6("pm25"), "total")


@query(
    "F1_page_after",
    sql("readings", "SELECT event_id, round(no2,6) AS no2 FROM readings WHERE no2<300 OR (no2=300 AND event_id>2000) ORDER BY readings.no2 DESC, event_id LIMIT 50"),
)
def page_after(spark, sf_dir):
    return ls.page_after(Inputs(spark, sf_dir).readings, "no2", "event_id", 300.0, 2000, 50).select("event_id", *r6("no2"))


@query(
    "F2_order_by_score_desc",
    sql("reports", "SELECT factory_id, round(composite_score,6) AS composite_score, row_number() OVER (ORDER BY composite_score DESC, factory_id) AS position FROM reports"),
)
def order_by_score(spark, sf_dir):
    placed = wn.number_in_order(Inputs(spark, sf_dir).reports, [F.col("composite_score").desc(), F.col("factory_id")], "position")
    return placed.select("factory_id", *r6("composite_score"), "position")


@query(
    "F3_top_critical",
    sql("reports", "SELECT factory_name, risk_level, round(composite_score,6) AS composite_score, dominant_pollutant, top_action FROM reports ORDER BY reports.composite_score DESC, factory_id LIMIT 10"),
)
def top_critical(spark, sf_dir):
    out = rp.top_critical(Inputs(spark, sf_dir).reports)
    return out.withColumn("composite_score", F.round("composite_score", 6))


@query(
    "F4_deterministic_sample",
    sql("readings", f"SELECT event_id, {s6('pm25')} FROM readings ORDER BY md5('42:'||event_id), event_id LIMIT 2000"),
)
def deterministic_sample(spark, sf_dir):
    return wn.deterministic_sample(Inputs(spark, sf_dir).readings, 2000, 42, "event_id").select("event_id", *r6("pm25"))
