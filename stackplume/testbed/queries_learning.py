"""L and the training jobs, at the full sizes that the functions have by default."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import forecasting as fc
from stackplume.operators import learning as ln
from stackplume.plans import training as tn
from stackplume.plans.scoring import recommend
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.queries_sources import scratch
from stackplume.testbed.sqltext import case_sql, r6 as s6, sql


def _usable(spark, sf_dir):
    return ln.fill_modes(Inputs(spark, sf_dir).ml_dataset.where(f"{ln.TARGET} IS NOT NULL"), ln.CATEGORICAL_FEATURES)


@query(
    "L1_preprocess",
    sql("targets", "SELECT event_id, round((coalesce(no2,m)-a)/s,6) AS no2_scaled, CAST(1 AS BIGINT) AS hot_city FROM targets, "
        "(SELECT median(no2) AS m, avg(no2) AS a, stddev_samp(no2) AS s FROM targets WHERE pollution_impact_score IS NOT NULL) WHERE pollution_impact_score IS NOT NULL"),
)
def preprocess(spark, sf_dir):
    rows = ln.prepared(_usable(spark, sf_dir))
    out = ln.fit_preprocessing(rows).transform(rows)
    place = ln.NUMERIC_FEATURES.index("no2")
    hot = F.aggregate(vector_to_array("city_hot"), F.lit(0.0), lambda a, b: a + b)
    return out.select(
        "event_id", F.round(vector_to_array("scaled")[place], 6).alias("no2_scaled"), hot.cast("bigint").alias("hot_city")
    )


def _trained(spark, sf_dir, estimator):
    rows = _usable(spark, sf_dir)
    model = ln.fit(rows.where("split IN ('train', 'val')"), estimator)
    return rows, model


@query("L2_train_random_forest")
def random_forest(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, ln.random_forest())
    return ln.evaluate(model, rows.where("split = 'test'"), "random_forest")


@query("L3_train_boosted_trees")
def boosted_trees(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, ln.boosted_trees())
    return ln.evaluate(model, rows.where("split = 'test'"), "boosted_trees")


@query("L4_cross_validate_r2")
def cross_validate(spark, sf_dir):
    rows = _usable(spark, sf_dir).where("split IN ('train', 'val')")
    mean, spread = ln.cross_validated_r2(rows, ln.random_forest(), ["event_id"])
    return spark.createDataFrame([("random_forest", mean, spread)], "model string, cv_r2_mean double, cv_r2_std double")


@query("P4_train_impact_models")
def train_impact_models(spark, sf_dir):
    result = tn.train_impact_models(Inputs(spark, sf_dir).ml_dataset, ["event_id"])
    return result.metrics


@query("L6_model_report")
def model_report(spark, sf_dir):
    result = tn.train_impact_models(Inputs(spark, sf_dir).ml_dataset, ["event_id"])
    folder = scratch(spark)
    result.model.write().save(f"{folder}/model")
    features = ", ".join([*ln.NUMERIC_FEATURES, *ln.CATEGORICAL_FEATURES])
    result.metrics.withColumn("features", F.lit(features)).write.json(f"{folder}/report")
    return spark.read.json(f"{folder}/report")


@query("L7_batch_score")
def batch_score(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, ln.random_forest())
    return ln.batch_score(model, rows).select("event_id", *r6("predicted_score"), "risk_level")


@query("L14_F5_feature_importances")
def importances(spark, sf_dir):
    rows, model = _trained(spark, sf_dir, ln.random_forest())
    return ln.feature_importances(model, rows)


@query("L8_train_action_recommender")
def action_recommender(spark, sf_dir):
    _, metrics = tn.train_recommender(Inputs(spark, sf_dir).scored_readings, ["event_id"])
    return metrics


@query("L9_predict_actions")
def predict_actions(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    recommender, _ = tn.train_recommender(t.scored_readings, ["event_id"])
    out = ln.predict_actions(recommender, t.scored)
    return out.select("factory_id", F.array_join("categories", "|").alias("categories"))


@query("P6_recommendations_with_learned_actions")
def recommendations_with_learned(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    recommender, _ = tn.train_recommender(t.scored_readings, ["event_id"])
    suggestions = ln.predict_actions(recommender, t.scored).select("factory_id", "categories")
    out = recommend(t.factories, t.near_city, "2024-02-01T00:00:00+00:00", suggestions)
    return out.select("factory_id", "risk_level", F.array_join(F.transform("recommendations", lambda a: a["action"]), " > ").alias("actions"))


@query(
    "L10_forecast_features",
    sql("monthly", "SELECT factory_id, year, month, CAST((year-2020)*12+month AS BIGINT) AS time_index, round((year-2020)/10e0,6) AS year_norm, "
        f"{case_sql('lower(industry_type)', {k.lower(): v for k, v in C.INDUSTRY_GROWTH.items()}, '1.5e0')} AS industry_growth, {case_sql('city', C.CITY_URBANISATION, '1.02e0')} AS city_urbanization, "
        "round(coalesce(lag(s,1) OVER w, s),6) AS score_lag_1, round(coalesce(lag(s,3) OVER w, s),6) AS score_lag_3, " + s6("pm25 o3")
        + " FROM (SELECT *, pollution_impact_score AS s FROM monthly) WINDOW w AS (PARTITION BY factory_id ORDER BY year, month)"),
)
def forecast_features(spark, sf_dir):
    out = fc.forecast_features(Inputs(spark, sf_dir).monthly)
    return out.select(
        "factory_id", "year", "month", F.col("time_index").cast("bigint").alias("time_index"), *r6("year_norm"), "industry_growth",
        "city_urbanization", *r6("score_lag_1", "score_lag_3", "pm25", "o3"),
    )


def _forecaster(spark, sf_dir):
    return tn.train_forecast(Inputs(spark, sf_dir).monthly)


@query("L11_train_forecaster")
def forecaster(spark, sf_dir):
    return _forecaster(spark, sf_dir)[1]


@query("L12_forecast_recursive")
def forecast_recursive(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    model, _ = _forecaster(spark, sf_dir)
    started = t.scored.select("factory_id", "industry_type", "city", F.coalesce("composite_score", F.lit(5.0)).alias("current_score"))
    return fc.forecast_monthly(started, model, 10, "with_interventions").withColumn("score", F.round("score", 6))


@query("P15_forecast_sites")
def forecast_sites(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    model, _ = _forecaster(spark, sf_dir)
    rows = t.scored.select("factory_id", "industry_type", "city", F.col("composite_score").alias("pollution_impact_score"), "pm25")
    yearly, trends = tn.forecast_sites(rows, model, 5)
    return yearly.join(trends, "factory_id").select(
        "factory_id", "year", *r6("predicted_score", "confidence_lower", "confidence_upper"), "trend", "risk_trajectory"
    )
