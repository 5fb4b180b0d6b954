"""Incremental ingestion of readings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackplume.operators.cleaning import clip_ranges

IDENTITY = ["station_name", "timestamp", "source"]


def clean_readings(readings: DataFrame) -> DataFrame:
    """Readable times, one row per station, time and source, clipped values."""
    timed = readings.withColumn("timestamp", F.col("timestamp").cast("timestamp")).where(F.col("timestamp").isNotNull())
    return clip_ranges(timed.dropDuplicates(IDENTITY))


def append_new(batch: DataFrame, path: str, batch_id: int) -> None:
    """Append the rows of a batch that the table does not hold yet; a repeated batch replaces what it wrote before.

    The table is partitioned by day, so only the days that the batch touches are compared, however old they are: a row
    is never too late.
    """
    spark = batch.sparkSession
    rows = clean_readings(batch).withColumn("day", F.to_date("timestamp")).withColumn("batch_id", F.lit(batch_id))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        stored = None
    if stored is not None:
        span = batch.agg(F.min(F.to_date("timestamp")).alias("first"), F.max(F.to_date("timestamp")).alias("last")).first()
        if span["first"] is None:
            return
        known = stored.where((F.col("batch_id") != batch_id) & F.col("day").between(span["first"], span["last"])).alias("known")
        same = F.col("new.day") == F.col("known.day")
        for name in IDENTITY:
            same = same & F.col(f"new.{name}").eqNullSafe(F.col(f"known.{name}"))
        rows = rows.alias("new").join(known, same, "left_anti")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def start_ingest(readings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived since the last run, appended to a Parquet table exactly once."""
    return (
        readings.writeStream.foreachBatch(lambda batch, batch_id: append_new(batch, path, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
