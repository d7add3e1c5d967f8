"""Session helpers: a test session and the lineage cut used by the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trialframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; a temporary one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        named = os.path.join(tempfile.mkdtemp(prefix="trialframe-"), "checkpoints")
    sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    Used where one table feeds several branches (so the raw rows are scanned
    once) and between rounds of an iterative fit (so lineage stays short). A
    lost executor re-reads the files; nothing upstream runs again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again.

    For large tables that are read several times: columns are compressed, and a reader
    takes those it needs.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A side is broadcast only when its counted rows times its row size stay below this.
BROADCAST_BYTES = 64 << 20


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast hint for a materialized table whose counted size is within bounds.

    Spares the other, larger side a shuffle. Beyond the bound the table is
    returned as it is, and the join runs as a shuffle join that adaptive
    execution splits where a key is hot.
    """
    return F.broadcast(df) if fits_broadcast(df.count(), row_bytes) else df
