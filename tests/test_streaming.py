"""Streams fed in several files give the batch result."""

import datetime as dt

from pyspark.sql import functions as F

from stackplume.streaming import city_stats, ingest

SCHEMA = "timestamp timestamp, station_name string, city string, source string, pm25 double, pm10 double, aqi_index double"


def write_batches(spark, folder):
    rows = []
    for i in range(60):
        moment = dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i)
        rows.append((moment, f"s{i % 3}", f"c{i % 2}", "live", float(i * 20 - 40), None if i % 7 == 0 else float(i), float(i)))
    for part in range(3):
        chunk = rows[part * 20:(part + 1) * 20]
        if part:
            chunk = chunk + rows[part * 20 - 5:part * 20]  # the look-back repeats what the last run delivered
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, SCHEMA)


def test_ingest_removes_repeats_across_batches(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batch = write_batches(spark, folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest.start_ingest(stream, out, f"{tmp_path}/state").awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == batch.count()
    assert stored.agg(F.min("pm25"), F.max("pm25")).first()[:] == (0.0, 500.0)
    # A second run finds nothing new.
    ingest.start_ingest(stream, out, f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(out).count() == batch.count()


def late_batches(spark, folder):
    """A second file whose rows are 40, 50 and 60 days older than the first one's."""
    newest = dt.datetime(2024, 6, 1)
    rows = [(newest - dt.timedelta(days=d), f"s{d}", "c", "live", 1.0, 2.0, 3.0) for d in (0, 1, 2, 40, 50, 60)]
    for part in (rows[:3], rows[3:] + rows[:1]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_kept(spark, tmp_path):
    folder = f"{tmp_path}/in"
    late_batches(spark, folder)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest.start_ingest(stream(), f"{tmp_path}/out", f"{tmp_path}/s1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    ingest.append_new(spark.read.schema(SCHEMA).parquet(folder), f"{tmp_path}/out", 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    city_stats.start_city_stats(stream(), f"{tmp_path}/partials", f"{tmp_path}/s2").awaitTermination()
    assert city_stats.recent_stats(spark, f"{tmp_path}/partials", 100).first()["reading_count"] == 7
    city_stats.compact(spark, f"{tmp_path}/partials", f"{tmp_path}/compacted")
    assert city_stats.recent_stats(spark, f"{tmp_path}/compacted", 100).first()["reading_count"] == 7


def test_city_stats_equal_the_batch_result(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write_batches(spark, folder)
    stored = spark.read.schema(SCHEMA).parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    city_stats.start_city_stats(stream, out, f"{tmp_path}/state").awaitTermination()
    mine = {r["city"]: tuple(r)[1:] for r in city_stats.recent_stats(spark, out, 10_000).collect()}
    from stackplume.operators.aggregates import city_stats as batch_stats

    assert mine == {r["city"]: tuple(r)[1:] for r in batch_stats(stored).collect()}
