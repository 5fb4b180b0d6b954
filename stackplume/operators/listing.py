"""Filters and pages behind the list views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def filter_contains(df: DataFrame, text: str | None, name: str = "city", regex: bool = False) -> DataFrame:
    """Rows whose column contains the text in any case; with ``regex`` the text is a pattern."""
    if not text:
        return df
    value = F.coalesce(F.col(name), F.lit(""))
    return df.where(value.rlike(f"(?i){text}") if regex else F.lower(value).contains(text.lower()))


def filter_equal_text(df: DataFrame, text: str | None, name: str) -> DataFrame:
    """Case-insensitive equality, NULL counting as empty."""
    return df if not text else df.where(F.lower(F.coalesce(F.col(name), F.lit(""))) == text.lower())


def filter_city_exact(df: DataFrame, city: str | None, limit: int | None = None, order: list | None = None) -> DataFrame:
    """Rows of a city, any case; with a limit the first so many in the given order."""
    if city:
        df = df.where(F.lower(F.trim(F.coalesce("city", F.lit("")))) == city.lower())
    return df if limit is None else df.orderBy(*order).limit(limit)


def filter_parameter_present(df: DataFrame, parameter: str | None) -> DataFrame:
    return df.where(F.col(parameter).isNotNull()) if parameter and parameter in df.columns else df


def filter_date_range(df: DataFrame, start: str | None = None, end: str | None = None, name: str = "timestamp") -> DataFrame:
    """Whole days from ``start`` to ``end``, both included."""
    if start:
        df = df.where(F.col(name) >= F.lit(dt.datetime.fromisoformat(start)).cast("timestamp_ntz"))
    if end:
        following = dt.datetime.fromisoformat(end) + dt.timedelta(days=1)
        df = df.where(F.col(name) < F.lit(following).cast("timestamp_ntz"))
    return df


def filter_recent_days(df: DataFrame, days: int, as_of: str | None = None, name: str = "timestamp") -> DataFrame:
    """Rows of the last ``days`` before ``as_of`` (default: the newest row of the table)."""
    if as_of:
        until = F.lit(dt.datetime.fromisoformat(as_of)).cast("timestamp_ntz")
    else:
        until = df.agg(F.max(name).alias("newest")).scalar()
    return df.where(F.col(name) >= until - F.make_dt_interval(F.lit(days)))


def paginate(df: DataFrame, page: int, page_size: int, order: list) -> DataFrame:
    """One page in a total order."""
    if page < 1 or page_size < 1:
        raise ValueError("pages and page sizes count from one")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, score: str, key: str, last_score: float, last_key: str, page_size: int) -> DataFrame:
    """Next page after a known last row: deep pages without sorting what came before."""
    behind = (F.col(score) < last_score) | ((F.col(score) == last_score) & (F.col(key) > last_key))
    return df.where(behind).orderBy(F.col(score).desc(), key).limit(page_size)


def with_total(page: DataFrame, source: DataFrame) -> DataFrame:
    """Page rows with the number of rows before paging."""
    return page.withColumn("total", source.agg(F.count(F.lit(1)).alias("n")).scalar())
