"""From records to the lines of each sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Sink names, channel prefix, and the events that leave the log.
META_SERVER = "metaserver"
GRAPHITE = "graphite"
CHANNEL = "CHANNEL@SPARK@"
EXTERNAL_EVENTS = ["APP_START", "APP_END", "STAGE_COMPLETED", "TASK_FAILED", "EXECUTOR_REMOVED"]


def clock_text(ms: Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss.SSS`` in UTC, whatever the session zone is."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    stamp = epoch + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,3)"))
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS")


def console_lines(records: DataFrame) -> DataFrame:
    """``<time> <LEVEL>: <text>``, one row per record."""
    line = F.concat(clock_text(F.col("eval_ms")), F.lit(" "), F.col("level"), F.lit(": "), F.col("text"))
    return records.select("app_id", "event", line.alias("line"))


def event_json(records: DataFrame) -> DataFrame:
    """``{"channel":"CHANNEL@SPARK@<EVENT>","event":{…}}``; the event is null for diagnoses."""
    line = F.concat(
        F.lit(f'{{"channel":"{CHANNEL}'), F.col("event"), F.lit('","event":'),
        F.coalesce(F.col("body"), F.lit("null")), F.lit("}"),
    )
    return records.select("app_id", "event", line.alias("line"))


def graphite_lines(records: DataFrame, epoch_s: int | str) -> DataFrame:
    """``<prefix>_<field> <value> <epoch seconds>``, one row per point; the time may be SQL."""
    points = records.selectExpr("app_id", "event", f"bigint({epoch_s}) AS epoch_s", "explode(points) AS point")
    return points.selectExpr("app_id", "event", "concat(point, ' ', epoch_s) AS line")


def external_lines(
    records: DataFrame, sink_type: str, address: str | None, epoch_s: int | str
) -> DataFrame | None:
    """Lines for the external sink, or None without one: unknown name, or no address."""
    outgoing = records.filter(F.col("event").isin(EXTERNAL_EVENTS))
    kind = (sink_type or "").lower()
    if not address:
        return None
    if kind == META_SERVER:
        return event_json(outgoing)
    if kind == GRAPHITE:
        return graphite_lines(outgoing, epoch_s)
    return None


def route(
    records: DataFrame, sink_type: str = META_SERVER, address: str | None = None,
    epoch_s: int | str = 0,
) -> DataFrame:
    """``(sink, app_id, event, line)``: every record to the log, some events to the external sink."""
    log = console_lines(records).select(F.lit("log").alias("sink"), "app_id", "event", "line")
    external = external_lines(records, sink_type, address, epoch_s)
    if external is None:
        return log
    return log.unionByName(external.select(F.lit(sink_type.lower()).alias("sink"), "app_id", "event", "line"))


def deliver(
    records: DataFrame, log_path: str, sink_type: str = META_SERVER, address: str | None = None,
    epoch_s: int | str = 0, mode: str = "append",
) -> None:
    """Writes the log and, if there is one, the external sink as text; ``address`` is its folder.

    The records, which may cost a whole diagnosis, are computed once and read again for the second sink.
    """
    if external_lines(records, sink_type, address, epoch_s) is not None:
        records = materialise(records, "records")
    console_lines(records).select("line").write.mode(mode).text(log_path)
    external = external_lines(records, sink_type, address, epoch_s)
    if external is not None:
        external.select("line").write.mode(mode).text(address)
