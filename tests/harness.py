"""Runs a registered query in Spark and its oracle in DuckDB and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        if math.isnan(value):
            return "NULL"
        return repr(value + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark_df, oracle) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    if sorted(spark_df.columns) != sorted(oracle.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(oracle.columns)}"
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = rows_of(oracle.columns, oracle.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(mine)} rows differ, columns {sorted(spark_df.columns)}: {different[0][0]} != {different[0][1]}"
    return None
