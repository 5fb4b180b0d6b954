"""Monthly forecast of site scores.

The model is a boosted forest trained by Spark ML.  A forecast feeds each month's prediction into the next month's
features, so the state of a site (its last three scores) is a row that every month moves on: features by expressions,
one transformation by the fitted model, and the row is stored every few months.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackplume.functions.numeric import clamp
from stackplume.operators.learning import fit_trees, stored_matrix
from stackplume.operators.matching import growth_and_urbanisation
from stackplume.operators.windows import lag_features
from stackplume.session import ensure_checkpoint_dir

SCORE = "pollution_impact_score"
NUMERIC = [
    "time_index", "year_norm", "month_sin", "month_cos", "industry_growth", "city_urbanization",
    "pm25", "pm10", "co", "no2", "so2", "o3", "rolling_avg_pm25_7d", "rolling_avg_pm25_30d",
    "score_lag_1", "score_lag_3", "score_rolling_mean_3",
]
CATEGORICAL = ["industry_type", "city"]
BASE_YEAR = 2025
FIRST_INDEX = 61  # January 2025 counted from December 2019


def time_encodings(year="year", month="month") -> dict[str, Column]:
    y, m = F.col(year), F.col(month)
    angle = 2 * math.pi * m / 12
    return {
        "time_index": (y - 2020) * 12 + m,
        "year_norm": (y - 2020) / 10.0,
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def forecast_features(history: DataFrame, past_only: bool = False) -> DataFrame:
    """Time encodings, growth factors and lags of a monthly history."""
    encoded = growth_and_urbanisation(history.withColumns(time_encodings()))
    return lag_features(encoded, "factory_id", ["year", "month"], SCORE, past_only)


def with_rolling_levels(history: DataFrame) -> DataFrame:
    """A monthly history has no daily rolling means; the month's PM2.5 stands in, as in the forecast itself."""
    return history.withColumns({"rolling_avg_pm25_7d": F.col("pm25"), "rolling_avg_pm25_30d": F.col("pm25")})


def train_forecaster(features: DataFrame, rounds: int = 200, depth: int = 5, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Boosted trees on numbers and one-hot categories; NULL numbers become 0."""
    stages = [
        StringIndexer(
            inputCols=CATEGORICAL, outputCols=[f"{c}_index" for c in CATEGORICAL], handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in CATEGORICAL], outputCols=[f"{c}_hot" for c in CATEGORICAL],
            handleInvalid="keep", dropLast=False,
        ),
        VectorAssembler(inputCols=[f"{c}_hot" for c in CATEGORICAL], outputCol="categories"),
        VectorAssembler(inputCols=[*NUMERIC, "categories"], outputCol="features"),
    ]
    ensure_checkpoint_dir(features.sparkSession)
    rows = numbers_filled(features).select(SCORE, *[c for c in [*NUMERIC, *CATEGORICAL] if c != SCORE]).checkpoint()
    encoder = Pipeline(stages=stages).fit(rows)
    boosted = GBTRegressor(
        labelCol=SCORE, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, checkpointInterval=10
    )
    forest = fit_trees(stored_matrix(encoder.transform(rows), SCORE), boosted)
    return PipelineModel(stages=[*encoder.stages, forest])


def numbers_filled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC})


#: Months after which the state of all sites is stored.
STORED_EVERY = 6


def month_inputs(m: int, steps: int) -> dict[str, Column]:
    """Features of forecast month ``m`` (0 is the first) from start, s1, s2, s3: the first score and the last three.

    The last three scores of a site begin with its first one; before they are three, the first one stands for them.
    """
    start, s1, s2, s3 = (F.col(c) for c in ("start", "s1", "s2", "s3"))
    growth, urban = F.col("industry_growth"), F.col("city_urbanization")
    month = m % 12 + 1
    rise, spread, drift = 1 + growth / 100 * m / 12, 1 + (urban - 1) * m / 12, 1 + 0.2 * m / steps
    pm25 = (20 + 15 * s1) * rise
    columns = {
        "time_index": F.lit(float(FIRST_INDEX + m)), "year_norm": F.lit((BASE_YEAR + m // 12 - 2020) / 10.0),
        "month_sin": F.lit(math.sin(2 * math.pi * month / 12)), "month_cos": F.lit(math.cos(2 * math.pi * month / 12)),
        "pm25": pm25, "pm10": (40 + 20 * s1) * rise, "co": (0.5 + 0.3 * s1) * drift, "no2": (15 + 8 * s1) * spread,
        "so2": (8 + 4 * s1) * drift, "o3": (20 + 5 * s1) * drift, "rolling_avg_pm25_7d": pm25, "rolling_avg_pm25_30d": pm25,
        "score_lag_1": s1, "score_lag_3": s3 if m >= 2 else start, "score_rolling_mean_3": (s3 + s2 + s1) / 3 if m >= 2 else start,
    }
    return {c: F.coalesce(v.cast("double"), F.lit(0.0)) for c, v in columns.items()}


def forecast_monthly(
    sites: DataFrame, model: PipelineModel, years: int = 10, scenario: str = "business_as_usual", partitions: int | None = None
) -> DataFrame:
    """factory_id, year, month, score for 12 * ``years`` months.  ``sites``: factory_id, industry_type, city, current_score.

    A site without a current score gets NULL scores.
    """
    spark = sites.sparkSession
    ensure_checkpoint_dir(spark)
    encoder, assembler, forest = PipelineModel(stages=model.stages[:-2]), model.stages[-2], model.stages[-1]
    shrink = 0.7 if scenario == "with_interventions" else 1.0
    steps = 12 * years
    start = F.col("current_score").cast("double")
    kept = ["factory_id", "start", "industry_growth", "city_urbanization", "categories"]
    # Few columns but many months for each row: spread them over the cluster first.
    state = encoder.transform(growth_and_urbanisation(sites)).select(
        "factory_id", start.alias("start"), *(F.col(c).cast("double").alias(c) for c in ("industry_growth", "city_urbanization")), "categories",
        *(start.alias(c) for c in ("s1", "s2", "s3")), F.array().cast("array<double>").alias("scores"),
    ).repartition(partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "factory_id").checkpoint()
    for m in range(steps):
        predicted = forest.transform(assembler.transform(state.withColumns(month_inputs(m, steps))))
        moved = predicted.withColumn("score", clamp(F.col("start") + (F.col("prediction") - F.col("start")) * shrink, 0, 10))
        state = moved.select(
            *kept, F.col("score").alias("s1"), F.col("s1").alias("s2"), F.col("s2").alias("s3"), F.array_append("scores", F.col("score")).alias("scores")
        )
        if (m + 1) % STORED_EVERY == 0:
            state = state.checkpoint()
    return state.select("factory_id", F.posexplode("scores").alias("m", "score")).select(
        "factory_id", (BASE_YEAR + F.floor(F.col("m") / 12)).cast("int").alias("year"), (F.col("m") % 12 + 1).cast("int").alias("month"), "score"
    )
