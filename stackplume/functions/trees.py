"""Offset-planting expressions.

The order of multiplications and divisions is part of the result (ceilings and the capacity comparison react to the
last bit), so the expressions are written out rather than simplified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.aqi import aqi_band_national
from stackplume.functions.numeric import column, lookup, printed

GASES = ("no2", "so2", "co")


def target_aqi(aqi) -> Column:
    a = column(aqi)
    return F.when(a > 400, 300.0).when(a > 300, 200.0).when(a > 200, 100.0).when(a.isNotNull(), 50.0)


def impact_radius_km(score) -> Column:
    return F.least(1.0 + column(score) * 0.2, F.lit(5.0))


def impact_area_km2(radius) -> Column:
    r = column(radius)
    return F.lit(math.pi) * (r * r)


def trees_for(pollutant: str, current, target, area_km2) -> Column:
    """Trees needed to bring one pollutant from ``current`` to ``target`` over the area; NULL in, NULL out."""
    now = column(current)
    drop = F.greatest(now - column(target), F.lit(0.0))
    per_tree = C.TREE_UPTAKE[pollutant] * C.TREE_CANOPY_M2
    if pollutant in GASES:
        per_tree = per_tree * 1_000_000
    return F.when(now.isNotNull(), (drop * (column(area_km2) * 1_000_000)) / F.lit(per_tree))


def base_trees(dominant, counts: dict[str, Column]) -> Column:
    """Count for the dominant pollutant, or the largest positive one; rounded up, at least one tree."""
    name = F.lower(column(dominant))
    chosen = F.lit(None).cast("double")
    for p, count in counts.items():
        chosen = F.when(name == p, count).otherwise(chosen)
    positive = [F.when(c > 0, c) for c in counts.values()]
    fallback = F.coalesce(F.greatest(*positive), F.lit(0.0))
    picked = F.when(chosen > 0, chosen).otherwise(fallback)
    return F.greatest(F.ceil(picked), F.lit(1).cast("bigint"))


def with_buffer(base, tier: str) -> Column:
    return F.ceil(column(base) * F.lit(C.TREE_BUFFERS[tier]))


def planting_hectares(trees) -> Column:
    return column(trees) * C.TREE_CANOPY_M2 / 10_000


def co2_tons(trees) -> Column:
    return column(trees) * F.lit(C.TREE_CO2_TONS)


def aqi_drop_rate(dominant) -> Column:
    return lookup(C.AQI_DROP_PER_1000, F.lower(column(dominant)), C.DEFAULT_AQI_DROP)


def aqi_drop(trees, dominant) -> Column:
    return (column(trees) / 1000) * aqi_drop_rate(dominant)


def feasibility(trees, hectares) -> Column:
    """High/Medium/Low from the tree count, and Low whenever the land cannot hold them."""
    n, area = column(trees), column(hectares)
    by_count = F.when(n < 500, F.lit("High")).when(n < 2000, F.lit("Medium")).otherwise(F.lit("Low"))
    capacity = (area * 10_000) / C.TREE_CANOPY_M2
    return F.when((area > 0) & (n > capacity), F.lit("Low")).otherwise(by_count)


def plan_notes() -> Column:
    """Seven sentences about a finished plan (expects the plan columns)."""
    small = F.col("minimum_trees")
    detail = (
        F.when(small < 500, F.lit("< 500 trees — highly practical"))
        .when(small < 2000, F.lit("500–2 000 trees — medium-scale greening programme"))
        .otherwise(F.lit("> 2 000 trees — large-scale urban forestry required"))
    )
    whole = lambda c: F.bround(F.col(c), 0).cast("bigint")
    return F.array(
        F.format_string(
            "Current AQI %d → targeting %d (%s band).",
            whole("current_aqi"), whole("target_aqi"), aqi_band_national("target_aqi"),
        ),
        F.format_string(
            "Impact zone radius: %s km (%s km² total area).", printed("impact_radius_km", 1), printed("impact_area_km2", 1)
        ),
        F.format_string(
            "Recommended planting: %d trees across %s ha (at %d trees/ha density).",
            F.col("recommended_trees"), printed("hectares", 2), F.lit(C.TREES_PER_HECTARE),
        ),
        F.format_string(
            "Annual CO₂ sequestration: %s t CO₂ (%s kg/tree/year at maturity).",
            printed("co2_tons", 1), F.lit(str(C.TREE_CO2_KG)),
        ),
        F.format_string(
            "Estimated AQI improvement after %d-year maturity: %s AQI points.",
            F.lit(C.MATURITY_YEARS), printed("aqi_drop", 1),
        ),
        F.format_string(
            "Dominant pollutant: %s — trees reduce %s AQI pts per 1 000 trees.",
            F.upper("dominant_pollutant"), printed(aqi_drop_rate("dominant_pollutant"), 1),
        ),
        F.format_string("Feasibility: %s (%s).", F.col("feasibility"), detail),
    )
