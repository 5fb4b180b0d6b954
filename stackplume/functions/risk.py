"""Risk scores, bands and the texts derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.numeric import clamp, column, ladder, lookup, printed, total
from stackplume.functions.text import title_words


def band_score(value, pollutant: str) -> Column:
    """Piecewise linear 0-10 score of a concentration; above the severe threshold it stays 10."""
    v = column(value)
    good, moderate, poor, severe = C.RISK_THRESHOLDS[pollutant]
    steps = [(0.0, good, 0, 2), (good, moderate, 2, 5), (moderate, poor, 5, 8), (poor, severe, 8, 10)]
    expression = F.when(v.isNull(), F.lit(None).cast("double"))
    for low, high, from_score, to_score in steps:
        expression = expression.when(v <= high, from_score + (to_score - from_score) * (v - low) / (high - low))
    return expression.otherwise(F.lit(10.0))


def score_columns() -> list[Column]:
    return [band_score(p, p).alias(f"{p}_score") for p in C.SCORED_POLLUTANTS]


def composite_risk() -> Column:
    """Weighted mean of the scores that are present; NULL when none is."""
    parts, weights = [], []
    for p in C.SCORED_POLLUTANTS:
        score = F.col(f"{p}_score")
        weight = F.lit(C.RISK_WEIGHTS[p])
        parts.append(F.coalesce(weight * score, F.lit(0.0)))
        weights.append(F.when(score.isNotNull(), weight).otherwise(F.lit(0.0)))
    weight_sum = total(weights)
    return F.when(weight_sum > 0, total(parts) / weight_sum)


def dominant_pollutant() -> Column:
    """Pollutant with the highest score; the fixed order settles ties."""
    scores = [F.col(f"{p}_score") for p in C.SCORED_POLLUTANTS]
    best = F.greatest(*scores)
    expression = F.when(best.isNull(), F.lit("Unknown"))
    for p, score in zip(C.SCORED_POLLUTANTS, scores):
        expression = expression.when(score == best, F.lit(p))
    return expression


def risk_band_4(score) -> Column:
    """Low/Medium/High/Critical; NULL is Unknown."""
    s = column(score)
    return F.coalesce(ladder(s, [(3, "Low"), (6, "Medium"), (8, "High")], "Critical", strict=True), F.lit("Unknown"))


def risk_band_3(score, low_max: float = 3.0, medium_max: float = 6.0) -> Column:
    return ladder(column(score), [(low_max, "Low"), (medium_max, "Medium")], "High")


def risk_band_100(score) -> Column:
    s = column(score)
    return (
        F.when(s >= 70, F.lit("High")).when(s >= 40, F.lit("Moderate")).when(s.isNotNull(), F.lit("Low"))
    )


def normalise_score_100(score, half_up: bool = False) -> Column:
    """0-10 or 0-100 score to a whole 0-100 score; missing counts as 55.  Halves go to even, or up for the page view."""
    s = F.coalesce(column(score), F.lit(55.0))
    scaled = F.when(s <= 10, s * 10).otherwise(s)
    return (F.floor(scaled + 0.5) if half_up else F.bround(scaled, 0)).cast("bigint")


def current_score(score="pollution_impact_score", pm25="pm25") -> Column:
    """Stored score, else an estimate from PM2.5, else the middle of the scale."""
    return F.coalesce(column(score), clamp((column(pm25) - 20) / 15, 0, 10), F.lit(5.0))


def class_probabilities(score, low_max: float = 3.0, medium_max: float = 6.0) -> dict[str, Column]:
    """Low/Medium/High shares derived from a score."""
    s = column(score)
    above_low = (s - low_max) / (medium_max - low_max)
    above_medium = (s - medium_max) / (10.0 - medium_max)
    low = F.when(s <= low_max, 1.0 - (s / low_max) * 0.3).when(s.isNotNull(), F.lit(0.0))
    medium = (
        F.when(s <= low_max, (s / low_max) * 0.3)
        .when(s <= medium_max, 1.0 - above_low * 0.4)
        .otherwise(1.0 - above_medium * 0.3)
    )
    high = (
        F.when(s <= low_max, F.lit(0.0)).when(s <= medium_max, above_low * 0.4).otherwise(above_medium * 0.3)
    )
    whole = low + medium + high
    return {"prob_low": low / whole, "prob_medium": medium / whole, "prob_high": high / whole}


def site_advice(level, industry) -> Column:
    """Advice text of the ranked factory table."""
    title = title_words(column(industry))
    advice = lookup(C.SITE_ADVICE, column(level), C.SITE_ADVICE["Low"])
    return F.concat(title, advice)


def service_advice(level, industry) -> Column:
    """Advice text returned with a prediction."""
    industry = column(industry)
    title = F.when(F.coalesce(industry, F.lit("")) == "", F.lit("Industrial")).otherwise(title_words(industry))
    advice = lookup(C.SERVICE_ADVICE, column(level))
    return F.when(advice.isNull(), F.lit("Unknown risk level")).otherwise(F.concat(title, advice))


def control_measures(level) -> Column:
    """Measures for a level; an empty array for any other level."""
    expression = None
    for name, texts in C.CONTROL_MEASURES.items():
        branch = F.array(*[F.lit(t) for t in texts])
        expression = F.when(column(level) == name, branch) if expression is None else expression.when(
            column(level) == name, branch
        )
    return expression.otherwise(F.array().cast("array<string>"))


def report_summary(name, level, score, top_action) -> Column:
    return F.format_string(
        "%s is classified as %s risk with composite score %s. Top action: %s.",
        F.coalesce(column(name), F.lit("Factory")),
        F.coalesce(column(level), F.lit("Unknown")),
        printed(F.coalesce(column(score), F.lit(0.0)), 2),
        column(top_action),
    )


def influence_radius_m(level) -> Column:
    return F.when(column(level) == "Low", 5000).when(column(level) == "Medium", 10000).otherwise(15000)


def estimated_levels(score="score", pm25="latest_pm25", pm10="latest_pm10") -> dict[str, Column]:
    """Concentrations guessed from a 0-100 score where no reading exists."""
    s = column(score)

    def known(value) -> Column:
        v = column(value)
        return F.when(F.coalesce(v, F.lit(0.0)) != 0, v)

    return {
        "pm25": F.coalesce(known(pm25), F.round(20 + s * 1.2, 1)),
        "pm10": F.coalesce(known(pm10), F.round(34 + s * 1.55, 1)),
        "no2": F.round(16 + s * 0.75, 1),
        "so2": F.round(7 + s * 0.5, 1),
        "co": F.round(0.45 + s * 0.045, 2),
        "o3": F.round(14 + s * 0.43, 1),
    }


def impact_extent(score="score") -> dict[str, Column]:
    """Radius in km and population in millions from a 0-100 score."""
    s = column(score)
    return {"radius_km": F.round(1.3 + s / 22, 1), "population_m": F.round(0.24 + s * 0.014, 2)}


def forecast_change_percent(current, future) -> Column:
    now = column(current)
    return F.round(F.try_divide(column(future) - now, now) * 100, 1)
