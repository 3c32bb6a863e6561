"""Session helpers: where to put checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset a folder of our own is used, which only a local master may do: on a
    cluster a machine-local folder is invisible to the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="jobscope-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """The rows as a table in the shared folder, laid out by the columns ``parts`` if there are any, read back.

    For small results that are costly to compute and used more than once.  The table outlives lost
    executors, and each use reads only its columns.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
