"""What the physical plans must and must not contain."""

import pytest

from stackplume.operators import nearest as nr
from stackplume.operators.aggregates import city_stats
from stackplume.operators.quantiles import exact_quantiles
from stackplume.plans.scoring import site_risk_scores
from stackplume.testbed import catalog, fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nearest_search_compares_no_full_sides(spark, sf_dir, no_broadcast):
    r, f = fx.readings(spark, sf_dir), fx.factories(spark, sf_dir)
    for df in (nr.nearest_site_join(r, f), nr.nearest_distance_in_city(r, f)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    text = plan(city_stats(fx.readings_aqi(spark, sf_dir)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in text
    supplier = fx.table(spark, sf_dir, "supplier").where("s_acctbal BETWEEN 0 AND 100").select("s_suppkey")
    assert "GreaterThanOrEqual(s_acctbal" in plan(supplier)


def test_quantiles_aggregate_before_every_shuffle(spark, sf_dir):
    text = plan(exact_quantiles(fx.readings(spark, sf_dir), ["pm25"], [0.5], ["city"]))
    assert "partial_percentile_approx" in text and "partial_count" in text


def test_scoring_has_no_python_and_no_cross_join(spark, sf_dir, no_broadcast):
    near = fx.near_city(spark, sf_dir)
    text = plan(site_risk_scores(fx.factories(spark, sf_dir), near))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "WindowGroupLimit" in text


def test_every_query_has_a_name_from_the_inventory():
    queries, oracles = catalog.load()
    assert set(oracles) <= set(queries)
    without = {n for n in queries if n not in oracles}
    assert all(n.startswith(("L", "P4", "P6_recommendations_with", "P15")) for n in without)
