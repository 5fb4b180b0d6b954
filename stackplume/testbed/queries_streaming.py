"""K: streams over the given tables, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.aqi import naive_aqi
from stackplume.streaming import city_stats, ingest
from stackplume.testbed import fixtures as fx
from stackplume.testbed.catalog import query, r6
from stackplume.testbed.queries_sources import scratch
from stackplume.testbed.sqltext import even, num, sql


def streamed_readings(spark, sf_dir):
    """The readings view over the event files as a stream."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events*.parquet")
    return spark.sql(fx.READINGS.replace("FROM events", "FROM {events}"), events=events)


def _clipped(c: str) -> str:
    lo, hi = C.VALID_RANGES[c]
    return f"round(CASE WHEN {c}<{num(lo)} THEN {num(lo)} WHEN {c}>{num(hi)} THEN {num(hi)} ELSE {c} END,6) AS {c}"


@query(
    "K1_stream_ingest",
    sql("readings", "SELECT DISTINCT station_name, strftime(timestamp,'%Y-%m-%d %H:%M:%S.%f') AS timestamp, source, " + ", ".join(_clipped(c) for c in C.POLLUTANTS) + " FROM readings"),
)
def stream_ingest(spark, sf_dir):
    stream = streamed_readings(spark, sf_dir)
    again = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    repeated = stream.withColumn("copy", F.explode(again)).drop("copy")
    folder = scratch(spark)
    ingest.start_ingest(repeated, f"{folder}/table", f"{folder}/state").awaitTermination()
    stored = spark.read.parquet(f"{folder}/table")
    return stored.select(
        "station_name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "source", *r6(*C.POLLUTANTS)
    )


@query(
    "K2_stream_city_stats",
    sql("readings_aqi", f"SELECT city, {even('avg(pm25)', 2)} AS avg_pm25, {even('avg(pm10)', 2)} AS avg_pm10, {even('max(aqi_index)', 2)} AS max_aqi, count(*) AS reading_count FROM readings_aqi "
        "WHERE CAST(timestamp AS DATE)>(SELECT max(CAST(timestamp AS DATE)) FROM readings_aqi)-10 GROUP BY city"),
)
def stream_city_stats(spark, sf_dir):
    stream = streamed_readings(spark, sf_dir).withColumn("aqi_index", naive_aqi())
    folder = scratch(spark)
    city_stats.start_city_stats(stream, f"{folder}/partials", f"{folder}/state").awaitTermination()
    return city_stats.recent_stats(spark, f"{folder}/partials", 10)
