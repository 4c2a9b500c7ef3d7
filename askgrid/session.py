"""Session settings the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "askgrid", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the session's own, else a fresh local one.

    Lineage is cut only with ``checkpoint()``; on a cluster the folder named
    in ``spark.checkpoint.dir`` survives the loss of executors. The local
    fallback applies only to local masters, as in tests.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a shared folder")
    fallback = os.path.join(tempfile.mkdtemp(prefix="askgrid-checkpoint-"))
    context.setCheckpointDir(fallback)
    return fallback


def probe(spark: SparkSession) -> dict[str, str]:
    """Where a session is connected to."""
    row = spark.sql("SELECT current_catalog() AS catalog, current_database() AS database, "
                    "version() AS version").first()
    return row.asDict()
