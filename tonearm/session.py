"""Session settings shared by tests, bench and command-line use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def session(cores: str | int = "*", app: str = "tonearm", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session; on a cluster pass your own session to the operators instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TONEARM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; only where nothing is set
    (local tests) a private temporary folder is used.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tonearm-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialize(df):
    """Write ``df`` to the shared folder and read it back.

    Unlike a checkpoint the result keeps column pruning and size statistics, so
    later joins are planned on real sizes.  Lost executors cost nothing.
    """
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tonearm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, take at most ``most`` bytes; else as it is.

    For tables that a caller hands over; ``row_bytes`` is a generous size of one row.
    """
    rows = df.limit(most // row_bytes + 1).count()
    return F.broadcast(df) if rows * row_bytes <= most else df


def broadcast_few(df: DataFrame, ids: DataFrame, key: str, row_bytes: int, most: int = 64 << 20) -> DataFrame | None:
    """Rows of ``df`` whose ``key`` is among ``ids``, with a broadcast hint; None if these rows, counted, take more than ``most`` bytes.

    For wide rows that a long table of pairs needs: where one side of the pairs has few
    values, wide rows need not travel with every pair.
    """
    chosen = df.join(ids.select(key).distinct(), key, "left_semi")
    rows = chosen.limit(most // row_bytes + 1).count()
    return F.broadcast(chosen) if rows * row_bytes <= most else None
