"""Table scans, source selection and guarded appends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stackplume.operators.windows import first_per_key


def scan_table(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """First readable path of the list (parquet, JSON or CSV by suffix), or an empty table with the schema."""
    for path in paths:
        if path is None:
            continue
        reader = spark.read
        try:
            if path.rstrip("/").endswith(".parquet"):
                return with_schema(reader.parquet(path), schema)
            if path.rstrip("/").endswith(".json"):
                return reader.schema(schema).json(path)
            return reader.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
        except PySparkException:
            continue
    return spark.createDataFrame([], schema)


def with_schema(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its types and order, NULL where the table has none; other columns follow."""
    wanted = StructType.fromDDL(schema).fields
    have = {c.lower(): c for c in df.columns}
    named = {f.name.lower() for f in wanted}
    return df.select(
        *[
            (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in wanted
        ],
        *[c for c in df.columns if c.lower() not in named],
    )


def first_nonempty(sources: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """The first source with a row wins entirely and is tagged; later ones are not read."""
    for name, df in sources:
        if not df.isEmpty():
            return df.withColumn("source", F.lit(name))
    raise ValueError("no source holds any row")


def union_first_nonempty(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Same choice inside one query: rows of the best priority present."""
    stacked = None
    for priority, (name, df) in enumerate(sources):
        part = df.withColumns({"source": F.lit(name), "_priority": F.lit(priority)})
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    best = stacked.agg(F.min("_priority").alias("best")).scalar()
    return stacked.where(F.col("_priority") == best).drop("_priority")


def insert_if_absent(table: DataFrame, new: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append (first of each new key) and rows in conflict with the table or with an earlier new row.

    ``order`` must identify a row.  The first row per key comes from an aggregation, so a key that is repeated very
    often is reduced before the shuffle, and the join back can be split.
    """
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    mark = F.struct(*order)
    first = new.groupBy(key).agg(F.min(mark).alias("_first")).join(known, key, "left")
    judged = new.join(first, key).withColumn("_accepted", F.col("_known").isNull() & (mark == F.col("_first")))
    accepted = judged.where("_accepted").select(*new.columns)
    conflicts = judged.where("NOT _accepted").select(*new.columns)
    return accepted, conflicts


def append_with_parent(child: DataFrame, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Child rows whose parent exists, and the rejected rest."""
    parents = parent.select(key)
    return child.join(parents, key, "left_semi"), child.join(parents, key, "left_anti")


def stack_sources(base: DataFrame, extra: DataFrame, minimum: int, key: str, order: list) -> DataFrame:
    """Base rows, plus the extra rows if there are fewer than ``minimum``; base wins on a repeated key."""
    rows = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    added = extra.where(rows < minimum).withColumn("_priority", F.lit(1))
    stacked = base.withColumn("_priority", F.lit(0)).unionByName(added, allowMissingColumns=True)
    return first_per_key(stacked, [key], [F.col("_priority"), *order]).drop("_priority")
