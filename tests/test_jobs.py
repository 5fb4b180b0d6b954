"""The whole jobs: choice of source, stored tables, outputs, committed appends, evaluation of a model."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import learning as ln
from stackplume.plans import jobs
from stackplume.sources import committed
from stackplume.testbed import fixtures as fx

SITE = "factory_id string, n int"


def site_table(spark):
    return spark.createDataFrame([("f1", 18.52, 73.85, "Pune"), ("f2", 28.61, 77.20, "Delhi")], "factory_id string, latitude double, longitude double, city string")


def backfill_table(spark):
    rows = [
        ("S1", "2024-01-01 00:00:00", "10", "Pune", "18.52", "73.86"),
        ("S1", "2024-01-01 00:00:00", "99", "Pune", "18.52", "73.86"),
        ("S1", "2024-01-01 01:00:00", "9000", "Pune", "18.52", "73.86"),
        ("S2", "2024-01-01 00:00:00", "30", "Old Pune", "18.52", "73.86"),
        ("S3", "2024-01-01 00:00:00", "30", "Chennai", "13.08", "80.27"),
        ("S4", "soon", "30", "Pune", "18.52", "73.86"),
    ]
    return spark.createDataFrame(rows, "Station string, Date string, `PM2.5` string, City string, lat string, lng string")


def test_first_source_with_rows_is_taken_whole(spark, tmp_path):
    nothing = spark.createDataFrame([], "seq long, asked_city string, payload string")
    landed = {"backfill": backfill_table(spark), "live": nothing}
    out = jobs.collect_readings(landed, site_table(spark), f"{tmp_path}/a", ["Pune"], form="csv")
    assert out.source == "backfill" and out.raw.count() == 3
    raw = {(r["station_name"], r["timestamp"].hour): r["pm25"] for r in out.raw.collect()}
    clean = {(r["station_name"], r["timestamp"].hour): r["pm25"] for r in out.clean.collect()}
    # Of the repeated reading one stays; the raw table keeps the value that the clean one clips.
    assert raw == {("S1", 0): 10.0, ("S1", 1): 9000.0, ("S2", 0): 30.0}
    assert clean[("S1", 1)] == C.VALID_RANGES["pm25"][1]
    assert out.clean.where("pm25 IS NULL OR nearest_factory_distance_km > 50").isEmpty()


def test_known_backfill_rows_are_suppressed(spark):
    known = spark.createDataFrame([(" s1 ", "2024-01-01 00:00:00")], "station_name string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    rows = jobs.source_rows("backfill", backfill_table(spark), site_table(spark), ["Pune"], known)
    assert sorted(r["station_name"] for r in rows.collect()) == ["S1", "S2"]


def test_live_payloads_of_cities_without_centre_are_left_out(spark):
    payload = json.dumps({"parameter": "pm25", "value": 5.0, "location": "S", "datetime": "2024-01-01T00:00:00Z"})
    landed = spark.createDataFrame([(1, "Pune", payload), (2, "Surat", payload.replace('"S"', '"T"')), (3, "Nowhere", payload.replace('"S"', '"U"'))], "seq long, asked_city string, payload string")
    names = lambda cities: sorted(r["station_name"] for r in jobs.source_rows("live", landed, site_table(spark), cities).collect())
    assert names([]) == ["S"] and names(["Surat", "Nowhere"]) == ["S", "T"]


def test_no_source_writes_nothing(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.collect_readings({"backfill": backfill_table(spark)}, site_table(spark), f"{tmp_path}/b", ["Nagpur"])
    with pytest.raises(ValueError):
        jobs.source_rows("radio", backfill_table(spark), site_table(spark), [])
    assert not os.path.exists(f"{tmp_path}/b")


def test_sites_are_stored_in_three_steps(spark, sf_dir, tmp_path):
    out = jobs.collect_sites(fx.site_elements(spark, sf_dir), f"{tmp_path}/sites", "2024-02-01", form="csv")
    counts = out.counts.first()
    assert (counts["raw_rows"], counts["cleaned_rows"], counts["processed_rows"]) == (out.raw.count(), out.clean.count(), out.processed.count())
    assert sorted(os.listdir(f"{tmp_path}/sites")) == ["clean", "processed", "raw"]
    assert set(counts["industries"].split(",")) == {r[0] for r in out.processed.select("industry_type").distinct().collect()}


def test_stored_csv_keeps_odd_texts(spark, tmp_path):
    rows = [("a,\"b\"", 1.1), ("line\nbreak", None), ("", 0.1 + 0.2), (None, -0.0), ("back\\slash", 1e300)]
    df = spark.createDataFrame(rows, "t string, x double")
    read = lambda rows: sorted((r["t"] or "", repr(r["x"])) for r in rows)
    back = jobs.stored(df, f"{tmp_path}/csv", "csv").collect()
    assert read(back) == read(df.collect()) and sum(r["t"] is None for r in back) == 2
    assert sorted(map(repr, jobs.stored(df, f"{tmp_path}/parquet").collect())) == sorted(map(repr, df.collect()))


def test_reports_have_three_outputs(spark, sf_dir, tmp_path):
    folder = f"{tmp_path}/reports"
    out = jobs.store_recommendations(fx.factories(spark, sf_dir), fx.near_city(spark, sf_dir), folder, "now", top=3)
    n = fx.factories(spark, sf_dir).count()
    assert out.reports.count() == n and spark.read.option("header", True).csv(f"{folder}/csv").count() == n
    assert spark.read.json(f"{folder}/json/count").first()["count"] == n
    scores = [json.loads(r[0])["composite_score"] for r in spark.read.text(f"{folder}/json/reports").collect()]
    assert len(scores) == n
    assert [r["composite_score"] for r in out.critical.collect()] == sorted(scores, reverse=True)[:3]


def test_empty_inputs_give_no_report(spark, sf_dir, tmp_path):
    sites, readings = fx.factories(spark, sf_dir), fx.readings_aqi(spark, sf_dir)
    assert jobs.store_recommendations(sites.limit(0), readings, f"{tmp_path}/none", "now") is None
    assert jobs.store_recommendations(sites, readings.limit(0), f"{tmp_path}/none", "now") is None
    assert not os.path.exists(f"{tmp_path}/none")


def test_dataset_is_read_by_split(spark, sf_dir, tmp_path):
    out = jobs.prepare_dataset(fx.readings(spark, sf_dir), fx.factories(spark, sf_dir), str(tmp_path))
    plan = out.where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan, plan
    assert {r[0] for r in out.select("split").distinct().collect()} == {"train", "val", "test", None}
    assert out.where("split IS NULL AND pollution_impact_score IS NOT NULL").isEmpty()


def test_inserts_are_committed_once(spark, tmp_path):
    path = f"{tmp_path}/sites"
    rows = lambda *r: spark.createDataFrame(list(r), SITE)
    seen = lambda done: sorted((r["factory_id"], r["n"], r["batch"]) for r in done.table.collect())
    first = committed.insert_sites(path, rows(("a", 1), ("b", 2), ("b", 3), (None, 4)), "b1", ["n"])
    assert seen(first) == [("a", 1, "b1"), ("b", 2, "b1")]
    assert sorted(r["n"] for r in first.rejected.collect()) == [3, 4]
    second = committed.insert_sites(path, rows(("b", 5), ("c", 6)), "b2", ["n"])
    after = [("a", 1, "b1"), ("b", 2, "b1"), ("c", 6, "b2")]
    assert seen(second) == after
    assert [r["n"] for r in second.rejected.collect()] == [5]
    # A repeated batch gives the same table and the same verdicts.
    again = committed.insert_sites(path, rows(("b", 5), ("c", 6)), "b2", ["n"])
    assert seen(again) == after and [r["n"] for r in again.rejected.collect()] == [5]
    # A batch that is repeated with nothing in it is emptied.
    assert seen(committed.insert_sites(path, rows(("x", 0)).limit(0), "b2", ["n"])) == [("a", 1, "b1"), ("b", 2, "b1")]


def test_recommendations_need_their_site(spark, tmp_path):
    sites = spark.createDataFrame([("a",), ("a",), (None,)], "factory_id string")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3), (None, 4)], SITE)
    done = committed.insert_recommendations(f"{tmp_path}/rec", rows, "1", sites)
    assert sorted(r["n"] for r in done.table.collect()) == [1, 2]
    assert sorted(r["n"] for r in done.rejected.collect()) == [3, 4]
    assert done.table.schema["batch"].dataType.simpleString() == "string"


def test_odd_batches_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], SITE)
    with pytest.raises(ValueError):
        committed.insert_sites(f"{tmp_path}/x", rows, "../b", ["n"])
    with pytest.raises(ValueError):
        committed.insert_sites(f"{tmp_path}/x", rows.withColumn("batch", F.lit(1)), "b", ["n"])


def test_evaluation_takes_the_classes_of_the_model(spark, sf_dir):
    data = fx.ml_dataset(spark, sf_dir)
    usable = ln.fill_modes(data.where(f"{ln.TARGET} IS NOT NULL"), ln.CATEGORICAL_FEATURES)
    model = ln.fit(usable.where("split = 'train'"), ln.random_forest(5, 4))
    tables = jobs.evaluate_model(model, usable)
    band = lambda v: "Low" if v <= 3 else "Medium" if v <= 6 else "High"
    scored = model.transform(ln.prepared(usable.where("split = 'test'"))).select(ln.TARGET, "prediction").collect()
    pairs = [(band(r[0]), band(r[1])) for r in scored]
    hits = sum(a == b for a, b in pairs) / len(pairs)
    metrics = {r["label"]: r for r in tables["metrics"].collect()}
    assert metrics["accuracy"]["f1"] == pytest.approx(hits)
    shown = {r["label"]: (r["true_rows"], r["predicted_rows"]) for r in tables["distribution"].collect()}
    assert shown == {c: (sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)) for c in {x for p in pairs for x in p}}


def test_a_source_is_read_once(spark, tmp_path):
    """The choice of the source, its stations and the raw table share one pass over the landed rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    payload = json.dumps({"parameter": "pm25", "value": 5.0, "location": "S", "datetime": "2024-01-01T00:00:00Z", "coordinates": {"latitude": 18.52, "longitude": 73.86}})
    rows = spark.createDataFrame([(i, "Pune", payload.replace('"S"', f'"S{i}"')) for i in range(6)], "seq long, asked_city string, payload string")
    landed = {"live": rows.withColumn("payload", F.udf(counted, "string")("payload")), "backfill": backfill_table(spark)}
    out = jobs.collect_readings(landed, site_table(spark), f"{tmp_path}/once", ["Pune"])
    assert out.source == "live" and out.raw.count() == 6 and read.value == 6
