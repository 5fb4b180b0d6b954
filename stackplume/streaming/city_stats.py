"""City statistics kept current by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PARTIALS = ["pm25_sum", "pm25_rows", "pm10_sum", "pm10_rows", "max_aqi", "readings"]


def daily_partials(readings: DataFrame) -> DataFrame:
    """Sums, counts and maximum per day and city; means are left to the roll-up, which can then add days up."""
    timed = readings.withColumn("timestamp", F.col("timestamp").cast("timestamp")).where(
        F.col("timestamp").isNotNull() & F.col("city").isNotNull()
    )
    return timed.groupBy(F.to_date("timestamp").alias("day"), "city").agg(
        F.sum("pm25").alias("pm25_sum"), F.count("pm25").alias("pm25_rows"),
        F.sum("pm10").alias("pm10_sum"), F.count("pm10").alias("pm10_rows"),
        F.max("aqi_index").alias("max_aqi"), F.count(F.lit(1)).alias("readings"),
    )


def combined(partials: DataFrame) -> DataFrame:
    """Partials of several batches added up per day and city."""
    sums = [F.sum(c).alias(c) for c in PARTIALS if c != "max_aqi"]
    return partials.groupBy("day", "city").agg(*sums, F.max("max_aqi").alias("max_aqi"))


def start_city_stats(readings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the (day, city) partials of every batch under its own folder; a repeated batch overwrites itself.

    Partials of a day add up over batches, so a row counts however late it comes, and the stream keeps no state.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        daily_partials(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        readings.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Partials of all batches as one table in ``target``, which can take the place of ``path`` between two runs."""
    combined(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{target}/batch_id=0")


def recent_stats(spark: SparkSession, path: str, days: int = 30) -> DataFrame:
    """City statistics over the last days, added up over all batches."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("day").alias("d")).scalar()
    return (
        combined(stored.where(F.col("day") > F.date_sub(newest, days)))
        .groupBy("city")
        .agg(
            F.bround(F.try_divide(F.sum("pm25_sum"), F.sum("pm25_rows")), 2).alias("avg_pm25"),
            F.bround(F.try_divide(F.sum("pm10_sum"), F.sum("pm10_rows")), 2).alias("avg_pm10"),
            F.bround(F.max("max_aqi"), 2).alias("max_aqi"),
            F.sum("readings").alias("reading_count"),
        )
    )
