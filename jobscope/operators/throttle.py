"""Alert throttling: of the firings of one counter let the 1st, (N+1)th, (2N+1)th … through."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..settings import THROTTLE_GROUPS, THROTTLE_PERIODS
from .skew import running_total

# Alerts of this many consecutive stages, or this much time, are numbered in one task.
STAGES_PER_SLICE = 1024
SLICE_MS = 3_600_000

COUNTER = ["app_id", "throttle_group", "counter_executor"]
# Counter a rule belongs to; null for rules that are never throttled.
GROUP = "CASE rule {} END".format(" ".join(f"WHEN '{r}' THEN '{g}'" for r, g in THROTTLE_GROUPS.items()))


def passes(nth: str, periods: dict[str, int] | None = None) -> str:
    """SQL: whether the ``nth`` firing of a counter is let through."""
    known = {**THROTTLE_PERIODS, **(periods or {})}
    cases = " ".join(f"WHEN '{group}' THEN {n}" for group, n in known.items())
    return f"({nth} - 1) % CASE throttle_group {cases} END = 0"


def numbered(alerts: DataFrame) -> DataFrame:
    """Throttled alerts with their 1-based ``firing`` number within their counter.

    One counter per application and group, except heap alerts: one per executor.  Order: evaluation
    time, stage, rule.  A counter is cut into slices by evaluation hour and stage range, so a single
    application with a large share of all alerts is numbered by many tasks.
    """
    keyed = alerts.filter(f"{GROUP} IS NOT NULL").selectExpr(
        "*", f"{GROUP} AS throttle_group", f"if({GROUP} = 'heap', executor_id, '') AS counter_executor"
    )
    slices = [
        f"eval_ms div {SLICE_MS}",
        "if(throttle_group = 'heap', 0L, eval_ms)",
        f"coalesce(stage_id, -1) div {STAGES_PER_SLICE}",
    ]
    order = ["eval_ms", "stage_id", "stage_attempt_id", "rule_ord", "task_id"]
    return running_total(keyed, COUNTER, slices, order, "1", "firing")


def unthrottled(alerts: DataFrame) -> DataFrame:
    return alerts.filter(f"{GROUP} IS NULL")


def throttle(alerts: DataFrame, periods: dict[str, int] | None = None) -> DataFrame:
    """The alerts that pass; rules without a counter always pass.

    The alerts are read several times.  They are few but costly to find, so unless they are a table
    already, pass ``materialise(alerts, …)``.
    """
    passed = numbered(alerts).filter(passes("firing", periods))
    return passed.select(*alerts.columns).unionByName(unthrottled(alerts))
