"""The whole jobs: from landed inputs to stored tables.

Every job writes its tables below a folder and reads them back, so that the next step starts from what was stored and a
lost executor repeats no earlier step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import learning as ln
from stackplume.operators.aggregates import stage_counts
from stackplume.operators.matching import backfill_suppress, filter_city_targets
from stackplume.operators.nearest import city_centres
from stackplume.operators.reports import order_by_score, top_critical
from stackplume.plans import features, readings as rd, scoring, sites as st
from stackplume.plans.training import evaluation_tables
from stackplume.session import ensure_checkpoint_dir
from stackplume.sources import sinks
from stackplume.sources.payloads import normalise_backfill
from stackplume.sources.scan import first_nonempty, stack_sources

#: Sources of readings, the preferred one first.
SOURCE_ORDER = ("live", "open_data", "backfill")
#: Ties between repeated readings of one station, time and source.
READING_ORDER = ["city", "station_lat", "station_lon", *C.POLLUTANTS]


def stored(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table as ``parquet`` or ``csv`` and reads it back with the same columns and types.

    CSV has one spelling for an empty text and for NULL; both are NULL when read back.
    """
    if form == "csv":
        df.write.mode("overwrite").options(header=True, escape='"').csv(path)
        return df.sparkSession.read.schema(df.schema).options(header=True, escape='"', multiLine=True).csv(path)
    sinks.write_parquet(df, path, partition_by)
    return df.sparkSession.read.parquet(path).select(*df.columns)


@dataclass
class Readings:
    raw: DataFrame
    clean: DataFrame
    source: str


def source_rows(
    name: str, landed: DataFrame, sites: DataFrame, target_cities: list[str], known: DataFrame | None = None
) -> DataFrame:
    """Wide readings of one landed source.

    ``live``: measurement payloads (seq, asked_city, payload), of cities with a site or a known centre.  ``open_data``:
    records (seq, payload) and ``backfill``: a wide table, both of cities that contain a target or are contained in one.
    Backfill rows whose station and second are in ``known`` are suppressed.
    """
    if name == "live":
        spark = landed.sparkSession
        fixed = spark.createDataFrame(
            [(c, lat, lon) for c, _, lat, lon in C.CITIES if c in target_cities], "city string, lat double, lon double"
        )
        asked = city_centres(sites, fixed).select(F.col("city").alias("asked_city"))
        return rd.readings_from_measurements(landed.join(asked, "asked_city", "left_semi"), requested_city="asked_city")
    if name == "open_data":
        wide = rd.readings_from_open_records(landed)
    elif name == "backfill":
        wide = normalise_backfill(landed)
        if known is not None:
            wide = backfill_suppress(wide, known)
    else:
        raise ValueError(f"unknown source {name}")
    return filter_city_targets(wide, target_cities) if target_cities else wide


def collect_readings(
    landed: dict[str, DataFrame], sites: DataFrame, folder: str, target_cities: list[str],
    source_order: tuple[str, ...] = SOURCE_ORDER, threshold_km: float = 50.0, known: DataFrame | None = None,
    form: str = "parquet",
) -> Readings:
    """First source of the order with any row, as a raw and a clean table below ``folder``.

    Sources that did not land count as empty; without any row a ValueError is raised and nothing is written.  The clean
    table is built from the stored raw one.  The rows of a source are parsed once and kept: the choice, the stations and
    the raw table all read them.  Sources after the chosen one are not read.
    """
    ensure_checkpoint_dir(sites.sparkSession)
    wide = (
        (name, source_rows(name, landed[name], sites, target_cities, known).checkpoint())
        for name in source_order if name in landed
    )
    chosen = first_nonempty(wide)
    source = chosen.select("source").first()["source"]
    raw = stored(rd.raw_readings(chosen, sites, [F.col(c) for c in READING_ORDER], threshold_km), f"{folder}/raw", form)
    clean = stored(rd.clean_readings(raw), f"{folder}/clean", form)
    return Readings(raw, clean, source)


@dataclass
class Sites:
    raw: DataFrame
    clean: DataFrame
    processed: DataFrame
    counts: DataFrame


def collect_sites(
    elements: DataFrame, folder: str, run_date: str, supplementary: DataFrame | None = None, minimum: int = 50,
    form: str = "parquet", **clustering,
) -> Sites:
    """Raw, clean and processed site tables below ``folder``, and their row counts with cities and industries."""
    raw = stored(st.raw_sites(elements), f"{folder}/raw", form)
    cleaned = st.clean_sites(raw, run_date)
    if supplementary is not None:
        cleaned = stack_sources(cleaned, supplementary, minimum, "factory_id", [F.col("factory_id")])
    clean = stored(cleaned, f"{folder}/clean", form)
    processed = stored(st.process_sites(clean, **clustering), f"{folder}/processed", form)
    return Sites(raw, clean, processed, stage_counts(raw, clean, processed))


def prepare_dataset(readings: DataFrame, sites: DataFrame, folder: str, tie: str = "event_id", seed: int = 42) -> DataFrame:
    """The training dataset, stored by split so that training reads only the rows it asks for."""
    return stored(features.build_dataset(readings, sites, tie, seed), f"{folder}/dataset", partition_by=["split"])


def store_ranked_advice(dataset: DataFrame, folder: str) -> DataFrame:
    """Advice per site as CSV, the worst site first."""
    ranked = scoring.ranked_advice(dataset).orderBy(F.col("pollution_impact_score").desc_nulls_last(), "factory_id")
    return stored(ranked, f"{folder}/ranked_advice", "csv")


@dataclass
class Reports:
    reports: DataFrame
    critical: DataFrame


def store_recommendations(
    sites: DataFrame, readings: DataFrame, folder: str, generated_at: str, suggestions: DataFrame | None = None, top: int = 10
) -> Reports | None:
    """Reports as nested table, flat CSV and JSON documents, the worst site first, and the ``top`` most critical ones.

    None, and nothing written, when either input is empty.
    """
    if sites.isEmpty() or readings.isEmpty():
        return None
    reports = stored(scoring.recommend(sites, readings, generated_at, suggestions), f"{folder}/nested")
    ordered = order_by_score(reports)
    sinks.export_reports_csv(ordered, f"{folder}/csv")
    sinks.export_reports_json(ordered, f"{folder}/json")
    return Reports(reports, stored(top_critical(reports, top), f"{folder}/critical"))


def evaluate_model(model, dataset: DataFrame, split: str = "test") -> dict[str, DataFrame]:
    """Classification report of a trained score model on one split of the dataset.

    The classes of the predictions come from the model's own scores; rows without a target are left out.
    """
    rows = dataset.where((F.col("split") == split) & F.col(ln.TARGET).isNotNull())
    scored = model.transform(ln.prepared(rows))
    return evaluation_tables(scored, ln.TARGET, "prediction")
