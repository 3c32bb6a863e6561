"""A small table carried from micro-batch to micro-batch.

Two folders take turns: batch n reads what batch n−1 wrote and writes the other one.  A batch that
is retried, after a lost executor or a restart, reads the same input again and overwrites its own
output, so the table changes exactly once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class BatchTable:
    path: str
    schema: str

    def _folder(self, batch_id: int) -> str:
        return f"{self.path.rstrip('/')}/slot={batch_id % 2}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table as the batch before left it; empty for the first batch."""
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._folder(batch_id - 1))

    def latest(self, spark: SparkSession) -> DataFrame:
        """The table as the newest finished batch left it, for readers beside the query; needs a column ``batch_id``."""
        both = spark.read.schema(self.schema).option("ignoreMissingFiles", "true").parquet(
            *[self._folder(i) for i in (0, 1) if _exists(spark, self._folder(i))]
        )
        return both.join(both.agg(F.max("batch_id").alias("batch_id")), "batch_id")

    def write(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Replaces the table and returns it, read back."""
        df.write.mode("overwrite").parquet(self._folder(batch_id))
        return df.sparkSession.read.schema(self.schema).parquet(self._folder(batch_id))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state with several variables needs.

    They have the further ``settings`` too.
    """
    wanted = {PROVIDER: ROCKSDB, **(settings or {})}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Adds the rows of a batch to a table, once: a retry replaces its own part."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def run(
    stream: DataFrame, on_batch, checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Starts a query with a batch function: every interval, or once over all there is."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
