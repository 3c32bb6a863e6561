"""Readers: event logs, executor samples and host metrics as canonical tables."""

from .event_log import (
    event_tables,
    ingest_event_logs,
    ingested_tables,
    parse_event_log,
    parse_records,
    read_event_log,
    stream_ended_attempts,
    write_tables,
)
from .executor_samples import parse_executor_samples, read_executor_samples
from .prometheus import parse_prometheus

__all__ = [
    "event_tables",
    "ingest_event_logs",
    "ingested_tables",
    "parse_event_log",
    "parse_executor_samples",
    "parse_prometheus",
    "parse_records",
    "read_event_log",
    "read_executor_samples",
    "stream_ended_attempts",
    "write_tables",
]
