"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.numeric import column, lookup


def collapse_whitespace(value) -> Column:
    """NULL to empty text, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(column(value), F.lit("")), r"\s+", " "))


def title_words(value) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    pieces = F.regexp_extract_all(column(value), F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    cased = F.transform(
        pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2147483647)))
    )
    return F.array_join(cased, "")


def site_name(name, *fallback_ids) -> Column:
    """Cleaned, title-cased site name; an id-based name where nothing is left."""
    kept = F.regexp_replace(F.coalesce(column(name), F.lit("")), r"[^A-Za-z0-9\s\-&]", " ")
    kept = collapse_whitespace(kept)
    ids = [F.when(column(i) != "", column(i)) for i in fallback_ids]
    fallback = F.concat(F.lit("Industrial_Facility_"), F.coalesce(*ids, F.lit("unknown")))
    return F.when(kept != "", title_words(kept)).otherwise(fallback)


def industry_label(value) -> Column:
    """Canonical industry label; NULL or blank is unknown."""
    token = F.lower(F.trim(column(value)))
    return F.when(F.coalesce(token, F.lit("")) == "", F.lit("unknown")).otherwise(
        F.coalesce(lookup(C.INDUSTRY_ALIASES, token), token)
    )


def site_id(value) -> Column:
    """Only letters, digits and single inner underscores; anything empty is unknown."""
    text = F.trim(column(value))
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), "_+", "_")
    cleaned = F.regexp_replace(cleaned, "^_+|_+$", "")
    missing = text.isNull() | F.lower(text).isin("", "nan", "none") | (cleaned == "")
    return F.when(missing, F.lit("unknown")).otherwise(cleaned)


def industry_from_tags(tags) -> Column:
    """Industry of a site from its tag map: keyword groups in order, then the plain land-use tags."""
    tags = column(tags)

    def tag(key: str) -> Column:
        return F.lower(F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit("")))

    text = F.concat_ws(" ", *[tag(k) for k in ("industrial", "landuse", "man_made", "amenity", "building")])
    expression = None
    for label, words in C.INDUSTRY_KEYWORDS:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        expression = F.when(hit, F.lit(label)) if expression is None else expression.when(hit, F.lit(label))
    return (
        expression.when(tag("landuse") == "industrial", F.lit("general_industrial"))
        .when(tag("man_made") == "works", F.lit("manufacturing"))
        .when(tag("amenity") == "factory", F.lit("factory"))
        .otherwise(F.lit("unknown"))
    )


def risk_category(industry) -> Column:
    """Baseline risk of an industry."""
    token = F.lower(column(industry))
    return (
        F.when(token.isin(C.HIGH_RISK_INDUSTRIES), F.lit("High"))
        .when(token.isin(C.MEDIUM_RISK_INDUSTRIES), F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def industry_weight(industry) -> Column:
    return lookup(C.INDUSTRY_RISK_WEIGHT, F.lower(column(industry)), C.DEFAULT_INDUSTRY_WEIGHT)


def reading_key(station, timestamp) -> Column:
    """Station and second of a reading as one text; empty when the time is unreadable."""
    moment = F.date_format(F.try_to_timestamp(column(timestamp).cast("string")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(moment.isNull(), F.lit("")).otherwise(F.concat(F.lower(F.trim(column(station))), F.lit("|"), moment))


def season(timestamp) -> Column:
    month = F.month(column(timestamp))
    return (
        F.when(month.isin(12, 1, 2), F.lit("winter"))
        .when(month.isin(3, 4, 5), F.lit("summer"))
        .when(month.isin(6, 7, 8), F.lit("monsoon"))
        .when(month.isin(9, 10, 11), F.lit("post_monsoon"))
        .otherwise(F.lit("unknown"))
    )
