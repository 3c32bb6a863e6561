"""Executor samples as JSON lines, one folder per application and executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _lines(samples: DataFrame) -> DataFrame:
    """One JSON line per sample: as it came where ``raw`` is there, else its time and heap."""
    line = F.to_json(F.struct(F.col("ts_ms").alias("epochMillis"), F.col("heap_used").cast("double").alias("heapMemoryTotalUsed")))
    if "raw" in samples.columns:
        line = F.coalesce("raw", line)
    return samples.select("app_id", "executor_id", line.alias("value"))


def write_executor_samples(samples: DataFrame, root: str) -> None:
    """Appends the samples below ``root``.

    The rebalance brings the rows of a folder together, so there are few files, and splits a folder
    that is much larger than the others.
    """
    lines = _lines(samples).hint("rebalance", "app_id", "executor_id")
    lines.write.mode("append").partitionBy("app_id", "executor_id").text(root)


def stream_executor_samples(samples: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """The same from a stream, exactly once."""
    return (
        _lines(samples).writeStream.format("text").partitionBy("app_id", "executor_id")
        .option("path", root).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
