"""Host samples of the last minutes, kept as a table beside the stage monitor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import hosts
from .state import BatchTable, run

KEPT = "instance string, metric string, mode string, cpu string, ts_ms bigint, value double, batch_id bigint"
# Twice the look-back, so that a trigger somewhat behind still finds what it looks at.
KEEP_MS = 2 * hosts.LOOKBACK_MS


def recent_samples(
    samples: DataFrame, state_path: str, checkpoint: str, keep_ms: int = KEEP_MS, every: str | None = "3 seconds"
) -> StreamingQuery:
    """Keeps the loads and CPU counters of the last ``keep_ms`` up to the newest sample; older ones leave the table."""
    table = BatchTable(state_path, KEPT)
    columns = [part.split()[0] for part in KEPT.split(", ")][:-1]
    wanted = F.col("metric").isin(*hosts.LOADS.values()) | ((F.col("metric") == hosts.CPU) & F.col("mode").isin(hosts.CPU_MODES))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        seen = table.before(batch.sparkSession, batch_id).select(*columns).unionByName(batch.filter(wanted).select(*columns))
        newest = seen.agg(F.max("ts_ms")).first()[0] or 0
        kept = seen.filter(F.col("ts_ms") > newest - keep_ms)
        table.write(kept.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)

    return run(samples, on_batch, checkpoint, every=every)


def known_samples(state_path: str) -> Callable[[SparkSession], DataFrame]:
    """What :func:`recent_samples` has kept, as a function of the session, for :func:`stage_state.stage_monitor`."""
    return lambda spark: BatchTable(state_path, KEPT).latest(spark).drop("batch_id")
