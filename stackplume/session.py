"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "stackplume", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.  On a cluster the submitter sets master and memory."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the shared one that ``spark.checkpoint.dir`` names.

    A session on one machine may do without and gets a scratch folder; a cluster may not, since its executors cannot
    see a folder of the driver.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = shared or tempfile.mkdtemp(prefix="stackplume-checkpoint-")
    context.setCheckpointDir(folder)
    return folder
