"""Registry of the checked queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackplume.testbed import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


class Inputs:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(fx, name)(self.spark, self.sf_dir)


@lru_cache(maxsize=1)
def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All registered queries and oracles."""
    from stackplume.testbed import (  # noqa: F401
        queries_aggregates, queries_cleaning, queries_joins, queries_jobs, queries_stored, queries_learning, queries_reports,
        queries_scalars, queries_sources, queries_streaming, queries_windows,
    )

    return QUERIES, ORACLES
