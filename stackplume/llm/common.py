"""What the operators of this subpackage share: tables, labelled samples and cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackplume.session import ensure_checkpoint_dir

#: A word: a run without ASCII white space, for Java and Python regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Labelled rows with this remainder are held out of every training.
HOLDOUT_MODULUS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder; a NULL id is held out, so that nothing learns from it."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % HOLDOUT_MODULUS == 0, F.lit(True))


def materialise(df: DataFrame) -> DataFrame:
    """Run now and keep the rows in the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def all_training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y (0/1) of all training rows.

    Held-out rows, NULL ids and NULL labels are left out; an id with several labels counts once, with the larger one.
    """
    return (
        labels.where(~held_out() & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )


def training_labels(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``all_training_labels``, at most ``per_class`` rows of each class, the same rows in every run."""
    known = all_training_labels(labels, label).withColumn("_order", F.xxhash64("doc_id"))
    parts = [known.where(F.col("y") == y).orderBy("_order", "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "y")


def labelled_texts(documents: DataFrame, sample: DataFrame, *columns: str) -> DataFrame:
    """doc_id, y, text (and more columns) of the documents in a bounded sample.

    The sample is bounded by its parameter, so it is sent to the scan instead of shuffling the texts.
    """
    return documents.select("doc_id", "text", *columns).join(F.broadcast(sample), "doc_id")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


class Store:
    """Tables written to the shared checkpoint folder and read back, so lineage is cut and executors can be lost."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
