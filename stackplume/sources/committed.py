"""Committed appends: every batch of a table is a partition folder of its own.

A batch that is written again replaces only its own folder and is compared only with the other batches, so a job that was
cut off, or run twice, is repeated with the same result.  One writer per table at a time: Parquet folders have no lock.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stackplume.sources.scan import append_with_parent, insert_if_absent

BATCH = "batch"


@dataclass
class Committed:
    """The table after the commit, and the rows of this batch that were not taken.

    Both read the stored files: collect them, or read the table again, after another commit of the same batch.
    """

    table: DataFrame
    rejected: DataFrame


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All batches of a table; an empty table where there is none yet."""
    try:
        return spark.read.schema(_with_batch(schema)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _with_batch(schema))


def _with_batch(schema: StructType) -> StructType:
    if BATCH in schema.fieldNames():
        raise ValueError(f"the rows have a column {BATCH} of their own")
    return StructType([*schema.fields]).add(BATCH, "string")


def _commit(rows: DataFrame, path: str, batch: str) -> DataFrame:
    """Writes the folder of one batch anew, empty batches too."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"not a name of a batch: {batch!r}")
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")
    return read_table(rows.sparkSession, path, rows.schema)


def insert_sites(path: str, new: DataFrame, batch: str, order: list[str], key: str = "factory_id") -> Committed:
    """Appends the first row of each key that no other batch holds; the rest is in conflict.

    ``order`` must identify a row of ``new``.  A NULL key is in conflict, as a table constraint would have it.
    """
    keyed = new.where(F.col(key).isNotNull())
    table = read_table(new.sparkSession, path, new.schema)
    accepted, conflicts = insert_if_absent(table.where(F.col(BATCH) != batch).drop(BATCH), keyed, key, order)
    written = _commit(accepted, path, batch)
    # The verdict is taken from what was stored; the plan above would read the table that has just changed.
    kept = written.where(F.col(BATCH) == batch).select(*new.columns)
    mark = [F.col(f"new.{c}").eqNullSafe(F.col(f"kept.{c}")) for c in [key, *order]]
    rejected = new.alias("new").join(kept.alias("kept"), mark, "left_anti")
    return Committed(written, rejected)


def insert_recommendations(path: str, new: DataFrame, batch: str, sites: DataFrame, key: str = "factory_id") -> Committed:
    """Appends the rows whose site exists; a site may have any number of them.  The rest is rejected."""
    accepted, rejected = append_with_parent(new, sites.where(F.col(key).isNotNull()), key)
    return Committed(_commit(accepted.select(*new.columns), path, batch), rejected.select(*new.columns))
