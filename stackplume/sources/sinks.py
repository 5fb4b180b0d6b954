"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.operators.reports import CSV_COLUMNS, reports_to_flat


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def report_lines(reports: DataFrame) -> DataFrame:
    """One JSON document per report."""
    fields = [
        "factory_id", "factory_name", "industry_type", "city", "risk_level", "composite_score", "dominant_pollutant",
        "pollution_scores", "summary", "generated_at", "recommendations",
    ]
    return reports.select(F.to_json(F.struct(*fields)).alias("value"))


def export_reports_json(reports: DataFrame, path: str) -> None:
    """Report documents under ``path/reports`` and their number under ``path/count``."""
    report_lines(reports).write.mode("overwrite").text(f"{path}/reports")
    reports.agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").json(f"{path}/count")


def export_reports_csv(reports: DataFrame, path: str) -> None:
    """Flat reports with a header, also when there is no report."""
    flat = reports_to_flat(reports).select(*CSV_COLUMNS)
    if flat.isEmpty():
        flat = flat.coalesce(1)
    write_csv(flat, path)
