"""A training corpus from raw documents: rejects, near-copies, benchmark passages and secrets go, sources are mixed.

``STAGES`` are applied in order, each to all that the one before kept; ``run`` writes every stage to the session's
shared checkpoint folder and reads it back, so a lost executor repeats at most the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackplume.llm import decontaminate, fm_quality, mixing, secrets_scan, simhash
from stackplume.llm.common import table
from stackplume.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents; a stage that changes texts also changes their length."""
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = fm_quality.train(docs, table(spark, sf_dir, "labels"))
    return fm_quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts whose SimHash fingerprints are linked, with the shingles and bits of op6."""
    return simhash.keep_first(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that occurrences of benchmark windows cover."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _documents(decontaminate.remove_spans(found))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    model = secrets_scan.train(docs, table(spark, sf_dir, "labels"))
    return _documents(secrets_scan.redact(secrets_scan.scan(docs.select(*COLUMNS), model)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: No SQL: the first stage is a trained model, the last a subset-sum search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
