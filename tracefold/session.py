"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Day and hour columns are calendar UTC, so the session must be too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A document that repeats a key keeps its last value instead of being lost.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

BUILD_CONF = {
    **RUNTIME_CONF,
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "tracefold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings. `conf` uses `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in BUILD_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names.

    Only a local master may go without `spark.checkpoint.dir`: executors on
    other machines, or replacements for lost ones, could not read a local
    folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tracefold-")
    return f"{base.rstrip('/')}/tracefold/{name}-{uuid.uuid4().hex}"
