"""Writers: console lines, JSON events, Graphite lines and executor samples."""

from .delivery import console_lines, deliver, event_json, graphite_lines, route
from .executor_samples import write_executor_samples
from .records import (
    app_end_records,
    app_start_records,
    diagnosis_records,
    executor_records,
    failure_records,
    stage_records,
)

__all__ = [
    "app_end_records",
    "app_start_records",
    "console_lines",
    "deliver",
    "diagnosis_records",
    "event_json",
    "executor_records",
    "failure_records",
    "graphite_lines",
    "route",
    "stage_records",
    "write_executor_samples",
]
