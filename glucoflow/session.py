"""Session helpers.

The engine treats naive times as UTC, so the session time zone must be UTC.
Everything else (shuffle partitions, AQE) is left to the cluster's settings;
``get_spark`` only fills in values for local runs and tests.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ensure_session_defaults(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on; leave cluster tuning alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def get_spark(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Local session for tests, the bench and examples (UI off, AQE on)."""
    master = master or os.environ.get("GLUCOFLOW_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName("glucoflow")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GLUCOFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_session_defaults(spark)


def target_partitions(spark: SparkSession) -> int:
    """Partition count for stages that expand rows: the shuffle partition
    setting, at least the cluster's default parallelism when known."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        n = max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a remote session)
        pass
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a folder beside the
    warehouse takes its place; the setting itself can't be changed at run time.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a remote session)
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    path = current or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if sc is not None and not current:
        sc.setCheckpointDir(path)
    return path
