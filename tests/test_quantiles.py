"""Exact quantiles, with brackets that really cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackplume.operators.aggregates import composite_target, impute_medians, minmax_intensity, quantile_bins, spike_flag
from stackplume.operators.quantiles import exact_medians, exact_quantiles


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_equals_numpy(spark, accuracy):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(3, 2, 4000), np.full(2000, 7.0), rng.normal(0, 1, 1500)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    ps = [0.0, 0.05, 0.2, 0.5, 0.95, 0.999, 1.0]
    row = exact_quantiles(df, ["v"], ps, accuracy=accuracy).first()
    assert [row[f"q{i}"] for i in range(len(ps))] == pytest.approx(list(np.quantile(values, ps)))
    assert row["n"] == len(values)


def test_hot_key(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": ["hot"] * 6000 + ["a"] * 3 + ["b"] * 2, "v": rng.normal(10, 3, 6005)})
    out = {r["k"]: r["v"] for r in exact_quantiles(spark.createDataFrame(frame), ["v"], [0.5], ["k"], accuracy=50).selectExpr("k", "q0 AS v").collect()}
    assert out == pytest.approx(frame.groupby("k")["v"].median().to_dict())


def test_all_missing(spark):
    df = spark.createDataFrame([("s", None), ("s", None)], "station_name string, pm25 double")
    assert exact_medians(df, ["pm25"]).first()["pm25"] is None
    assert [r["pm25"] for r in impute_medians(df, ["pm25"]).collect()] == [None, None]
    assert [r["bin"] for r in quantile_bins(df, "pm25").collect()] == [None, None]


def test_impute_uses_the_filled_column_for_the_overall_median(spark):
    df = spark.createDataFrame(
        [("a", 10.0), ("a", None), ("b", None), (None, 4.0)], "station_name string, pm25 double"
    )
    out = sorted((r["station_name"] or "", r["pm25"]) for r in impute_medians(df, ["pm25"]).collect())
    assert out == [("", 4.0), ("a", 10.0), ("a", 10.0), ("b", 10.0)]


def test_equal_edges_are_merged(spark):
    df = spark.createDataFrame([(1.0,)] * 7 + [(2.0,), (3.0,), (4.0,)], "v double")
    out = sorted((r["v"], r["bin"]) for r in quantile_bins(df, "v").distinct().collect())
    values = np.array([1.0] * 7 + [2, 3, 4])
    expected = pd.qcut(values, 5, labels=False, duplicates="drop")
    assert out == sorted(set(zip(values, expected)))


def test_constant_columns(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "pm25 double")
    assert {r["intensity_normalized"] for r in minmax_intensity(df).collect()} == {1.0}
    assert {r["pollution_spike_flag"] for r in spike_flag(df).collect()} == {0}


def test_target_without_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None, 1.0, 1.0, 1.0, 1.0)], "pm25 double, pm10 double, no2 double, so2 double, co double, o3 double")
    assert composite_target(df).first()["pollution_impact_score"] is None


def test_table_medians_read_wide_rows(spark):
    """Rows are not multiplied by the number of columns; NaN and NULL count for nothing, beyond the small bracket too."""
    x, rows = F.col("id"), 50_001
    frame = spark.range(rows).select(
        x.alias("whole"), F.when(x % 3 == 0, x.cast("double")).alias("gaps"), F.when(x % 5 == 0, F.lit(float("nan"))).otherwise(x / 2).alias("odd"),
        F.lit(1.0).alias("same"), F.lit(None).cast("double").alias("none"),
    )
    found = exact_medians(frame, frame.columns)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = (
        float(np.median(np.arange(rows))), float(np.median(np.arange(0, rows, 3))),
        float(np.median([i / 2 for i in range(rows) if i % 5])), 1.0, None,
    )
    assert tuple(found.first()) == expected
    assert tuple(exact_medians(frame.limit(0), ["gaps", "same"]).first()) == (None, None)
