"""Site table from landed map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.functions.text import risk_category
from stackplume.operators import cleaning
from stackplume.operators.clustering import density_clusters
from stackplume.operators.nearest import urban_rural
from stackplume.operators.windows import first_per_key
from stackplume.sources.payloads import parse_site_elements, sanitise_sites
from stackplume.sources.scan import stack_sources


def raw_sites(elements: DataFrame) -> DataFrame:
    """Parsed elements, once per city and id.  ``elements``: city, seq, payload."""
    parsed = sanitise_sites(parse_site_elements(elements))
    return first_per_key(parsed, ["city", "osm_id"], ["seq"])


def clean_sites(raw: DataFrame, run_date: str, order: list | None = None) -> DataFrame:
    deduped = cleaning.drop_duplicate_sites(raw, order or ["seq", "city"])
    located = cleaning.validate_coords_country(deduped)
    return cleaning.add_derived_fields(cleaning.normalise_sites(located), run_date)


def process_sites(cleaned: DataFrame, eps_degrees: float = 0.05, min_samples: int = 2) -> DataFrame:
    """Urban class, baseline risk and cluster of every site, in the final column order."""
    classed = urban_rural(cleaned, cleaning.city_table(cleaned.sparkSession))
    rated = classed.withColumn("pollution_risk_category", risk_category("industry_type"))
    clusters = density_clusters(rated, "factory_id", eps_degrees=eps_degrees, min_samples=min_samples)
    return cleaning.enforce_schema(rated.join(clusters, "factory_id", "left"))


def build_sites(
    elements: DataFrame, run_date: str, supplementary: DataFrame | None = None, minimum: int = 50, **clustering
) -> DataFrame:
    """Elements to the processed site table; a supplementary table fills up when too few sites were found."""
    cleaned = clean_sites(raw_sites(elements), run_date)
    if supplementary is not None:
        cleaned = stack_sources(cleaned, supplementary, minimum, "factory_id", [F.col("factory_id")])
    return process_sites(cleaned, **clustering)
