"""Shared-storage helpers: where lineage is cut and intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a folder of its own; on a cluster an unset value is an error,
    because a machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    made = tempfile.mkdtemp(prefix="crosstide-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions the session starts a shuffle with."""
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(fixed, int(adaptive)) if adaptive else fixed


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/crosstide/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and continue from there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
