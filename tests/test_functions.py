"""Spot values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions import aqi, geo, risk, text, trees


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("pm25, expected", [(0.0, 0.0), (-3.0, 0.0), (15.0, 25.0), (30.0, 50.0), (45.0, 75.5), (600.0, 500.0)])
def test_national_index(spark, pm25, expected):
    assert value(spark, aqi.aqi_pm25_national(pm25)) == pytest.approx(expected)


@pytest.mark.parametrize("pm25, expected", [(6.0, 25), (12.0, 50), (12.09, 50), (35.4, 100), (55.4, 150), (500.4, 500), (900.0, 500)])
def test_epa_pm25(spark, pm25, expected):
    assert value(spark, aqi.aqi_pm25_epa(pm25)) == expected


@pytest.mark.parametrize("pm10, expected", [(27.0, 25), (54.9, 50), (154.0, 100), (604.0, 500), (700.0, 500)])
def test_epa_pm10(spark, pm10, expected):
    assert value(spark, aqi.aqi_pm10_epa(pm10)) == expected


def test_missing_values_stay_missing(spark):
    nothing = F.lit(None).cast("double")
    assert value(spark, aqi.aqi_pm25_national(nothing)) is None
    assert value(spark, aqi.aqi_pm25_epa(nothing)) is None
    assert value(spark, risk.band_score(nothing, "pm25")) is None
    assert value(spark, risk.risk_band_4(nothing)) == "Unknown"
    assert value(spark, aqi.aqi_from_pm(nothing, nothing)) == 0


@pytest.mark.parametrize("score, four, three", [(2.99, "Low", "Low"), (3.0, "Medium", "Low"), (6.0, "High", "Medium"), (8.0, "Critical", "High")])
def test_bands(spark, score, four, three):
    assert value(spark, risk.risk_band_4(score)) == four
    assert value(spark, risk.risk_band_3(score)) == three


@pytest.mark.parametrize("pollutant", C.SCORED_POLLUTANTS)
def test_band_score_edges(spark, pollutant):
    good, moderate, poor, severe = C.RISK_THRESHOLDS[pollutant]
    for concentration, expected in [(0.0, 0), (good, 2), (moderate, 5), (poor, 8), (severe, 10), (severe * 3, 10)]:
        assert value(spark, risk.band_score(concentration, pollutant)) == pytest.approx(expected)


def test_dominant_prefers_fixed_order_on_ties(spark):
    row = spark.createDataFrame([(5.0, 7.0, 7.0, None, 1.0, 7.0)], ", ".join(f"{p}_score double" for p in C.SCORED_POLLUTANTS))
    assert row.select(risk.dominant_pollutant().alias("d")).first()["d"] == "pm10"


def test_composite_ignores_missing(spark):
    row = spark.createDataFrame([(10.0, None, None, None, None, 4.0)], ", ".join(f"{p}_score double" for p in C.SCORED_POLLUTANTS))
    assert row.select(risk.composite_risk().alias("c")).first()["c"] == pytest.approx((0.3 * 10 + 0.05 * 4) / 0.35)


@pytest.mark.parametrize(
    "raw, expected",
    [("3m a-b", "3M A-B"), ("  ACME  steel&co. ", "Acme Steel&Co"), ("???", "Industrial_Facility_way_7"), (None, "Industrial_Facility_way_7")],
)
def test_site_name(spark, raw, expected):
    assert value(spark, text.site_name(F.lit(raw).cast("string"), F.lit("way_7"))) == expected


@pytest.mark.parametrize("raw, expected", [("node/12", "node_12"), (" NaN", "unknown"), ("__a//b__", "a_b"), ("//", "unknown"), (None, "unknown")])
def test_site_id(spark, raw, expected):
    assert value(spark, text.site_id(F.lit(raw).cast("string"))) == expected


def test_trees(spark):
    assert value(spark, trees.trees_for("pm25", 65.0, 30.0, 1.0)) == pytest.approx(437_500)
    assert [value(spark, trees.target_aqi(a)) for a in (450.0, 350.0, 250.0, 150.0)] == [300, 200, 100, 50]
    assert value(spark, trees.impact_radius_km(100.0)) == 5.0
    assert value(spark, trees.feasibility(F.lit(57), trees.planting_hectares(F.lit(57)))) == "Low"
    assert value(spark, trees.feasibility(F.lit(56), trees.planting_hectares(F.lit(56)))) == "High"


def test_haversine(spark):
    expected = 2 * 6371.0 * math.asin(math.sqrt(math.sin(math.radians(1) / 2) ** 2))
    assert value(spark, geo.haversine_km(0.0, 0.0, 1.0, 0.0)) == pytest.approx(expected)
    assert value(spark, geo.haversine_km(0.0, 0.0, 0.0, 180.0)) == pytest.approx(math.pi * 6371.0)


def test_box_gap_never_exceeds_the_distance(spark):
    import random

    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        south, west = rng.uniform(-89, 88), rng.uniform(-180, 178)
        north, east = south + rng.uniform(0, min(10, 90 - south)), west + rng.uniform(0, 180 - west)
        rows.append((rng.uniform(-90, 90), rng.uniform(-180, 180), south, north, west, east, rng.uniform(south, north), rng.uniform(west, east)))
    df = spark.createDataFrame(rows, "p double, q double, s double, n double, w double, e double, y double, x double")
    bad = df.where(geo.box_gap_km("p", "q", "s", "n", "w", "e") > geo.haversine_km("p", "q", "y", "x") + 1e-6)
    assert bad.count() == 0


def test_printed_like_the_binary_value(spark):
    from stackplume.functions.numeric import printed

    values = [372777.35, 0.25, 0.35, 2.5, 0.05, 0.15, 1e-9, 0.0, 9.995, 9.95, 1.005, 2.675, 123456789.125, 0.125, 0.375, -0.25, -0.04, 99.95, 1e15, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3):
        rows = df.select("v", printed("v", digits).alias("t")).collect()
        assert [r["t"] for r in rows] == [f"{r['v']:.{digits}f}" for r in rows]


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    import pytest

    from stackplume import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
