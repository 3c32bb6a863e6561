"""Whole runs: all rules over one set of telemetry tables."""

from .diagnosis import Telemetry, diagnose, event_records

__all__ = ["Telemetry", "diagnose", "event_records"]
