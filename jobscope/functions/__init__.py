"""Scalar functions, all native column expressions."""

from .failures import failure_advice, failure_class, failure_text
from .formats import fmt_bytes, fmt_duration, parse_size
from .paths import app_id_from_log_path, app_id_from_sample_path, executor_id_from_path

__all__ = [
    "app_id_from_log_path",
    "app_id_from_sample_path",
    "executor_id_from_path",
    "failure_advice",
    "failure_class",
    "failure_text",
    "fmt_bytes",
    "fmt_duration",
    "parse_size",
]
