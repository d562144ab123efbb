"""Helpers that read session settings; nothing here creates a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session. Only on a ``local`` master, where
    every task runs on this machine, is a temporary folder taken when the
    setting is missing; on a cluster a missing setting is an error, because a
    machine-local folder is not visible to the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="surgewatch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable: point the context at the shared folder."""
    if spark.sparkContext.getCheckpointDir():
        return
    spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows.

    The plan's lineage ends at the written files: a lost executor re-reads
    them instead of recomputing the plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only when counting proves that the frame holds at most ``max_rows``.

    The proof is a plain ``count()``: one number from each task. Meant for tables
    that are small by nature (countries, thresholds); larger dimensions get no
    hint, so Spark's own size threshold and AQE decide on bytes.
    """
    if not df.isStreaming and 0 < max_rows and df.count() <= max_rows:
        return F.broadcast(df)
    return df
