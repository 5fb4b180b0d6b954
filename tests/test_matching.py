"""Matching tiers, rules and reports on small hand-made tables."""

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import matching as mt
from stackplume.operators import reports as rp
from stackplume.operators import rules as rl
from stackplume.plans.planting import plan_inputs, tree_plans

SITE = "factory_id string, factory_name string, industry_type string, city string"
READING = "event_id int, timestamp timestamp, city string, nearest_factory_distance_km double, pm25 double, pm10 double, co double, no2 double, so2 double, o3 double"


def sites(spark):
    return spark.createDataFrame(
        [("a", "Alpha", "steel", "X"), ("b", "Beta", "chemical", "Y"), ("c", "Gamma", "toys", "Z")], SITE
    )


def readings(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    return spark.createDataFrame(
        [
            (1, day(3), "X", 5.0, 10.0, None, 1.0, 1.0, 1.0, 1.0),
            (2, day(2), "X", 1.0, None, 20.0, 1.0, 1.0, 1.0, 1.0),
            (3, day(1), "X", 1.0, 30.0, 30.0, 1.0, 1.0, 1.0, 1.0),
            (4, day(1), "Y", 500.0, 100.0, 40.0, 1.0, 1.0, 1.0, 1.0),
            (5, day(2), "Y", None, 200.0, 60.0, 1.0, 1.0, 1.0, 1.0),
        ],
        READING,
    )


def by_site(df):
    return {r["factory_id"]: r for r in df.collect()}


def test_nearest_city_and_national_tiers(spark):
    out = by_site(mt.match_nearest(sites(spark), readings(spark)))
    assert out["a"]["match_tier"] == "station" and out["a"]["pm25"] is None and out["a"]["pm10"] == 20.0
    assert out["b"]["match_tier"] == "city" and out["b"]["pm25"] == 150.0 and out["b"]["pm10"] == 50.0
    assert out["c"]["match_tier"] == "national" and out["c"]["pm25"] == 85.0


def test_first_row_variant_and_missing_columns(spark):
    out = by_site(mt.match_first(sites(spark), readings(spark)))
    assert out["a"]["pm25"] == 30.0
    bare = by_site(mt.match_first(sites(spark), readings(spark).drop("nearest_factory_distance_km")))
    assert {r["match_tier"] for r in bare.values()} == {"national"} and bare["a"]["pm25"] == 85.0


def test_no_readings_give_unknown_levels(spark):
    scored = mt.add_risk(mt.match_nearest(sites(spark), readings(spark).limit(0)))
    assert {r["risk_level"] for r in scored.collect()} == {"Unknown"}
    report = rp.assemble_reports(scored, "now").first()
    assert report["composite_score"] == 0.0 and report["pollution_scores"]["so2_score"] == 0.0


def scored_row(spark, level, industry="steel", composite=5.0, **scores):
    values = [scores.get(p) for p in C.SCORED_POLLUTANTS]
    columns = ", ".join(f"{p}_score double" for p in C.SCORED_POLLUTANTS)
    return spark.createDataFrame(
        [("a", "Alpha", industry, "X", *values, composite, level, "so2")],
        f"{SITE}, {columns}, composite_score double, risk_level string, dominant_pollutant string",
    )


def actions(df):
    return [r["action"] for r in rl.apply_rules(df).collect()]


def test_rules(spark):
    only_so2 = actions(scored_row(spark, "High", so2=6.5))
    assert len(only_so2) == 4 and not any("audit within 30 days" in a for a in only_so2)
    two = actions(scored_row(spark, "High", so2=6.5, pm10=9.0))
    assert any("Cyclone" in a for a in two) and any("audit within 30 days" in a for a in two)
    assert not any("Cyclone" in a for a in actions(scored_row(spark, "High", pm25=9.0)))
    assert any("audit within 30 days" in a for a in actions(scored_row(spark, "High", composite=6.1)))
    assert len(actions(scored_row(spark, "Medium"))) == 5 and len(actions(scored_row(spark, "Low"))) == 4
    assert actions(scored_row(spark, "Unknown", industry=None)) == ["Apply general pollution control measures as per CPCB guidelines"]


def test_merged_order_and_learned_actions(spark):
    names = F.array(F.lit("PM_Control"), F.lit("Audit"), F.lit("PM_Control"))
    row = rp.assemble_reports(scored_row(spark, "Medium", so2=7.0), "now", names).first()
    merged = row["recommendations"]
    ranks = [{"Immediate": 0, "Short-term": 1, "Long-term": 2}[a["priority"]] for a in merged if a["category"] != "ML Suggested"]
    assert ranks == sorted(ranks)
    assert [a["action"].split(": ")[1] for a in merged[-2:]] == ["Audit", "PM_Control"]
    assert f"Top action: {merged[0]['action']}." in row["summary"]


def test_flat_report_of_every_priority(spark):
    flat = rp.reports_to_flat(rp.assemble_reports(scored_row(spark, "Low", no2=7.0), "now")).first()
    assert flat["long_term_actions"].count(" | ") == 3
    assert "NOx CEMS" in flat["monitoring_actions"] and flat["composite_score"] == 5.0


def test_plan_without_report_uses_the_defaults(spark):
    reports = rp.assemble_reports(scored_row(spark, "High", so2=7.0), "now")
    plans = by_site(tree_plans(plan_inputs(sites(spark), reports)))
    assert plans["b"]["current_pollution_score"] == 5.0 and plans["b"]["dominant_pollutant"] == "pm25"
    assert plans["b"]["minimum_trees"] == 1 and plans["b"]["recommended_trees"] == 2
    assert len(plans["a"]["notes"]) == 7
    over = by_site(tree_plans(plan_inputs(sites(spark), reports), target=80.0))
    assert over["a"]["target_aqi"] == 80.0


def test_bulk_lookup_and_targets(spark):
    wanted = spark.createDataFrame([("a",), ("zz",)], "factory_id string")
    found, missing = mt.bulk_lookup(sites(spark), wanted)
    assert [r["factory_id"] for r in found.collect()] == ["a"]
    assert missing.first()["error"] == "Factory 'zz' not found"
    cities = spark.createDataFrame([("New Delhi",), ("del",), ("Goa",), (None,)], "city string")
    assert mt.filter_city_targets(cities, ["Delhi"]).count() == 3
