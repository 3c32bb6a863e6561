"""Executor heap samples: JSON lines in ``<root>/<app>/executor_<id>/``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import app_id_from_sample_path, executor_id_from_path

# Fields of a sample.
HEAP_FIELD = "$.heapMemoryTotalUsed"
TIME_FIELD = "$.epochMillis"


def parse_executor_samples(lines: DataFrame) -> DataFrame:
    """Samples from lines ``(path, value)``; a line without a heap value is no sample.

    The other fields of a sample are free; the line is kept in ``raw``.
    """
    heap = F.get_json_object("value", HEAP_FIELD).try_cast("double")
    return lines.select(
        app_id_from_sample_path(F.col("path")).alias("app_id"),
        executor_id_from_path(F.col("path")).alias("executor_id"),
        F.get_json_object("value", TIME_FIELD).try_cast("bigint").alias("ts_ms"),
        heap.try_cast("bigint").alias("heap_used"),
        F.col("value").alias("raw"),
    ).filter(F.col("heap_used").isNotNull() & F.col("executor_id").isNotNull())


def read_executor_samples(spark: SparkSession, root: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(root)
    return parse_executor_samples(text.select(F.col("_metadata.file_path").alias("path"), "value"))
