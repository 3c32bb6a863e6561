"""Thresholds, fixed floors and alert periods."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # The defaults decide which stages are reported.
    long_tail_ratio: float = 0.6
    shuffle_skew_ratio: float = 0.4
    input_skew_ratio: float = 0.6
    gc_ms: int = 20000
    gc_ratio: float = 0.7
    scheduler_delay_ratio: float = 0.2
    long_tail_gap_ms: int = 20000
    shuffle_gap_records: int = 2000
    input_gap_records: int = 5000
    old_task_ms: int = 10000
    gc_floor_ms: int = 1000
    p75_divisor: float = 1.5
    heap_ratio: float = 0.9
    lost_polls: int = 3
    finished_ratio: float = 0.5


# One alert in every N firings is let through, per throttle group.
THROTTLE_PERIODS = {
    "long_tail": 20,
    "skew": 10,
    "gc": 10,
    "host": 30,
    "heap": 10,
}

# Rules that share one counter share a group; rules without a group are never throttled.
THROTTLE_GROUPS = {
    "long_tail": "long_tail",
    "shuffle_read_skew": "skew",
    "shuffle_write_skew": "skew",
    "input_skew": "skew",
    "gc_overhead": "gc",
    "unexplained_straggler": "host",
    "heap_pressure": "heap",
}

# Order of evaluation inside one stage evaluation.
RULE_ORDER = {
    "shuffle_read_notice": 0,
    "long_tail": 1,
    "shuffle_read_skew": 2,
    "shuffle_write_skew": 3,
    "input_skew": 4,
    "gc_overhead": 5,
    "unexplained_straggler": 6,
    "scheduler_delay": 7,
    "task_failed": 8,
    "task_failure_cause": 9,
    "oom_report": 10,
    "heap_pressure": 11,
    "executor_lost": 12,
}

# A key with at least this many rows is "hot": its rows are never gathered in one task.  An
# aggregation task may hold the lists of about a hundred ordinary keys at a time.
HOT_ROWS = 100_000
# Hot keys up to this number (some megabytes) are broadcast, more are joined by a shuffle.
MAX_BROADCAST_KEYS = 100_000
