"""Scans, parsers and sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stackplume import schemas
from stackplume.operators import cleaning as cl
from stackplume.operators import listing as ls
from stackplume.sources import payloads, scan, sinks


def test_scan_falls_back_and_ends_with_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/sites.csv"
    spark.createDataFrame([("a", "A", "steel", 1.5, 2.5, "X", "S", "India", "o", "1", "d")], schemas.FACTORIES).write.option("header", True).csv(path)
    assert scan.scan_table(spark, [None, "/nowhere/x.parquet", path], schemas.FACTORIES).first()["latitude"] == 1.5
    empty = scan.scan_table(spark, ["/nowhere/x.json"], schemas.READINGS)
    assert empty.count() == 0 and "pm25" in empty.columns


def test_first_nonempty_raises_when_all_are_empty(spark):
    with pytest.raises(ValueError):
        scan.first_nonempty([("a", spark.range(0))])


def test_measurement_shapes(spark):
    texts = [
        '{"parameter":"PM25","value":1.5,"location":"S","date":{"utc":"2024-01-01T00:00:00Z"},"coordinates":{"latitude":1.0,"longitude":2.0},"city":"X","country":"IN"}',
        '{"parameter":{"name":"o3"},"value":null,"datetime":"2024-01-01T01:00:00Z","country":{"name":"India"}}',
        '{"parameter":"co","value":3,"period":{"datetimeTo":{"utc":"2024-01-02T00:00:00Z"}},"city":"Unknown"}',
        '{"parameter":"humidity","value":3,"datetime":"2024-01-01T01:00:00Z"}',
        '{"parameter":"co","value":3}',
        "not json",
    ]
    df = spark.createDataFrame([(i, t, "Pune") for i, t in enumerate(texts)], "seq int, payload string, asked string")
    out = {r["seq"]: r for r in payloads.parse_measurements(df, requested_city="asked").collect()}
    assert set(out) == {0, 1, 2}
    assert (out[0]["parameter"], out[0]["country"], out[0]["station_lat"], out[0]["reading_city"]) == ("pm25", "IN", 1.0, "X")
    assert (out[1]["value"], out[1]["country"], out[1]["station_name"], out[1]["reading_city"]) == (None, "India", "Unknown Station", "Pune")
    assert out[2]["timestamp"] == "2024-01-02T00:00:00Z" and out[2]["reading_city"] == "Pune"


def test_site_elements(spark):
    texts = [
        '{"type":"node","id":1,"lat":10.0,"lon":20.0,"tags":{"operator":"Op","industrial":"oil refinery"}}',
        '{"type":"way","id":2,"center":{"lat":11.0,"lon":21.0}}',
        '{"type":"way","id":3}',
    ]
    rows = payloads.parse_site_elements(spark.createDataFrame([(t,) for t in texts], "payload string")).orderBy("osm_id").collect()
    assert [(r["osm_id"], r["factory_name"], r["industry_type"], r["latitude"]) for r in rows] == [
        ("node_1", "Op", "chemical", 10.0), ("way_2", "Industrial_way_2", "unknown", 11.0),
    ]


def test_backfill_without_its_keys_is_empty(spark):
    assert payloads.normalise_backfill(spark.createDataFrame([(1.0,)], "pm25 double")).count() == 0


def test_open_record_with_a_bad_time_is_dropped(spark):
    texts = ['{"pollutant_id":"PM2.5","pollutant_avg":"NA","last_update":"2024-01-01 00:00:00","state":"S"}', '{"pollutant_id":"CO","pollutant_avg":"1","last_update":"x"}']
    rows = payloads.parse_open_records(spark.createDataFrame([(t,) for t in texts], "payload string")).collect()
    assert len(rows) == 1 and rows[0]["value"] is None and rows[0]["reading_city"] == "S"


def test_csv_of_no_reports_still_has_its_header(spark, tmp_path):
    from stackplume.operators.matching import add_risk
    from stackplume.operators.reports import CSV_COLUMNS, assemble_reports

    columns = ", ".join(f"{p} double" for p in ("pm25", "pm10", "so2", "no2", "co", "o3"))
    nothing = spark.createDataFrame([], f"factory_id string, factory_name string, industry_type string, city string, {columns}")
    path = f"{tmp_path}/reports"
    sinks.export_reports_csv(assemble_reports(add_risk(nothing), "now"), path)
    assert spark.read.option("header", True).csv(path).columns == CSV_COLUMNS


def test_insert_and_parent_checks(spark):
    table = spark.createDataFrame([("a",)], "id string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int")
    accepted, conflicts = scan.insert_if_absent(table, new, "id", ["n"])
    assert [tuple(r) for r in accepted.collect()] == [("b", 2)]
    assert sorted(tuple(r) for r in conflicts.collect()) == [("a", 1), ("b", 3)]
    kept, rejected = scan.append_with_parent(new, table, "id")
    assert kept.count() == 1 and rejected.count() == 2


def test_clipping_keeps_null_and_schema_fills_defaults(spark):
    df = spark.createDataFrame([(-1.0, None), (9999.0, 5.0)], "pm25 double, o3 double")
    assert sorted((r["pm25"], r["o3"]) for r in cl.clip_ranges(df).collect())[0] == (0.0, None)
    row = cl.enforce_schema(spark.createDataFrame([("a", "1.5")], "factory_id string, latitude string")).first()
    assert row["latitude"] == 1.5 and row["cluster_id"] == -1 and row["city"] == ""


def test_date_range_keeps_the_last_microsecond(spark):
    stamps = [dt.datetime(2024, 1, 2, 23, 59, 59, 999999), dt.datetime(2024, 1, 3), None]
    df = spark.createDataFrame([(s,) for s in stamps], "timestamp timestamp_ntz")
    assert ls.filter_date_range(df, "2024-01-01", "2024-01-02").count() == 1


def test_pages_are_limited(spark):
    df = spark.range(1000)
    assert ls.paginate(df, 1, 999, ["id"]).count() == min(999, df.count())
    assert [r["id"] for r in ls.paginate(df, 3, 10, ["id"]).collect()] == list(range(20, 30))


def test_quality_report_finds_the_faults(spark):
    site = "factory_id string, industry_type string, country string, latitude double, longitude double"
    sites = spark.createDataFrame([("a/1", "Steel", "India", 20.0, 70.0), ("a/1", "?", "Nepal", 60.0, 70.0)], site)
    reading = "timestamp timestamp, station_lat double, station_lon double, aqi_index double, pm25 double, pm10 double, co double, no2 double, so2 double"
    readings = spark.createDataFrame([(None, 95.0, 0.0, 900.0, -1.0, 1.0, 1.0, 1.0, None)], reading)
    reports = spark.createDataFrame([("Severe", 12.0)], "risk_level string, composite_score double")
    failed = {r["check_name"]: r["violations"] for r in cl.quality_report(sites, readings, reports).where("NOT passed").collect()}
    assert failed == {
        "site_id_slash": 2, "site_industry_token": 1, "site_country": 1, "site_id_unique": 1, "site_latitude_range": 1,
        "reading_pm25_range": 1, "reading_so2_range": 1, "reading_latitude_range": 1, "reading_timestamp": 1, "reading_aqi_range": 1,
        "report_level": 1, "report_score_range": 1,
    }
    assert [r[0] for r in cl.required_columns_report(sites, ["factory_id", "osm_id"]).collect()] == ["osm_id"]


def test_whitespace_and_numbers(spark):
    df = spark.createDataFrame([("  a \t b ", "1e3"), (None, "x")], "t string, n string")
    rows = cl.coerce_numeric(cl.collapse_whitespace(df, ["t"]), ["n"]).collect()
    assert sorted((r["t"], r["n"] or 0.0) for r in rows) == [("", 0.0), ("a b", 1000.0)]
    assert df.select(F.lit(1)).count() == 2


def test_payloads_are_parsed_once(spark):
    """Neither filters nor fields repeat the parsing, nor the making, of a payload."""
    rows = spark.range(3).select(F.col("id").alias("seq"), F.to_json(F.struct(F.col("id").alias("value"))).alias("payload"))
    for parse in (payloads.parse_measurements, payloads.parse_open_records, payloads.parse_site_elements):
        plan = parse(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("struct(value, id#") == 1
    nothing = spark.createDataFrame([(1, None), (2, "broken")], "seq int, payload string")
    assert payloads.parse_measurements(nothing).isEmpty() and payloads.parse_open_records(nothing).isEmpty()
