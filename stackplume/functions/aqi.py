"""Air-quality index functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.numeric import column, ladder


def naive_aqi(pm25="pm25", pm10="pm10") -> Column:
    """Mean of the particulate values that are present (a stand-in index, not an official one)."""
    a, b = column(pm25), column(pm10)
    return (
        F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2)
        .when(a.isNotNull(), a)
        .otherwise(b)
    )


def aqi_pm25_national(pm25="pm25") -> Column:
    """National index from PM2.5 by linear interpolation; the lower band wins on a shared edge."""
    x = column(pm25)
    expression = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(0.0))
    for c_lo, c_hi, i_lo, i_hi in C.NATIONAL_PM25_BANDS:
        expression = expression.when((x >= c_lo) & (x <= c_hi), F.lit((i_hi - i_lo) / (c_hi - c_lo)) * (x - c_lo) + i_lo)
    return expression.otherwise(F.lit(500.0))


def _epa(x: Column, bands) -> Column:
    expression = F.when(x.isNull(), F.lit(None).cast("bigint"))
    for upper, base, lower, index_span, span in bands:
        if base == 0.0:
            value = F.lit(index_span / span) * x
        else:
            value = base + F.lit(index_span / span) * (x - lower)
        expression = expression.when(x <= upper, value.cast("bigint"))
    return expression.otherwise(F.lit(500).cast("bigint"))


def aqi_pm25_epa(pm25="pm25") -> Column:
    """EPA index from PM2.5 cut (not rounded) to one decimal."""
    return _epa((column(pm25) * 10).cast("bigint") / F.lit(10.0), C.EPA_PM25_BANDS)


def aqi_pm10_epa(pm10="pm10") -> Column:
    """EPA index from PM10 cut to whole numbers."""
    return _epa(column(pm10).cast("bigint").cast("double"), C.EPA_PM10_BANDS)


def aqi_category_epa(aqi) -> Column:
    return ladder(column(aqi), C.EPA_CATEGORIES, C.EPA_LAST_CATEGORY)


def aqi_band_national(aqi) -> Column:
    return ladder(column(aqi), [(bound, name) for bound, name, _ in C.NATIONAL_BANDS], C.NATIONAL_LAST_BAND[0])


def aqi_colour_national(aqi) -> Column:
    return ladder(column(aqi), [(bound, colour) for bound, _, colour in C.NATIONAL_BANDS], C.NATIONAL_LAST_BAND[1])


def aqi_coalesced(aqi_index="aqi_index", pm25="pm25", pm10="pm10") -> Column:
    """Measured index, else from PM2.5, else half of PM10, else 100; rounded half-even to 2 places."""
    return F.bround(
        F.coalesce(column(aqi_index), aqi_pm25_national(pm25), column(pm10) / 2.0, F.lit(100.0)), 2
    )


def aqi_source(aqi_index="aqi_index", pm25="pm25", pm10="pm10") -> Column:
    """Where ``aqi_coalesced`` took its value from."""
    return (
        F.when(column(aqi_index).isNotNull(), F.lit("openaq"))
        .when(column(pm25).isNotNull(), F.lit("openaq_calculated"))
        .when(column(pm10).isNotNull(), F.lit("openaq_estimated"))
        .otherwise(F.lit("fallback"))
    )


def aqi_from_pm(pm25="pm25", pm10="pm10") -> Column:
    """EPA index from PM2.5, else from PM10, else 0."""
    return F.coalesce(aqi_pm25_epa(pm25), aqi_pm10_epa(pm10), F.lit(0).cast("bigint"))


def aqi_from_pm_category(pm25="pm25", pm10="pm10") -> Column:
    missing = column(pm25).isNull() & column(pm10).isNull()
    return F.when(missing, F.lit("Unknown")).otherwise(aqi_category_epa(aqi_from_pm(pm25, pm10)))


def score_to_concentration(score, pollutant: str) -> Column:
    """0-10 score to a representative concentration."""
    s = column(score)
    limited = F.when(s < 0, F.lit(0.0)).when(s > 10, F.lit(10.0)).otherwise(s)
    return limited / 10.0 * F.lit(C.SCORE_MAX_CONCENTRATION[pollutant])


def aqi_from_score(score) -> Column:
    return F.greatest(column(score) * 40.0, F.lit(50.0))
