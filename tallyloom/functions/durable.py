"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for logs and stream state."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the session's shared checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names. Where that is unset a temporary
    folder is taken in local mode (tests on one machine); on a cluster that is an error.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()
