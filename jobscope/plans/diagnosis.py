"""All diagnoses in one table, and all event records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import applications, executors, failures, hosts, lineage, rules, stages
from ..session import materialise
from ..settings import HOT_ROWS, Thresholds
from ..sinks import records as sink_records

DIAGNOSTIC_COLUMNS = [
    "app_id", "event", "level", "rule", "stage_id", "stage_attempt_id", "task_id", "executor_id",
    "eval_ms", "rule_ord", "message",
]


@dataclass
class Telemetry:
    """The input tables; what is absent makes the rules that need it silent."""

    tasks: DataFrame
    stages: DataFrame
    app_conf: DataFrame | None = None
    rdds: DataFrame | None = None
    samples: DataFrame | None = None
    polls: DataFrame | None = None
    host_samples: DataFrame | None = None
    host_names: DataFrame | None = None
    executors: DataFrame | None = None
    applications: DataFrame | None = None


def diagnose(
    t: Telemetry,
    eval_ms: int,
    th: Thresholds = Thresholds(),
    only_running: bool = False,
    hot_rows: int | None = HOT_ROWS,
    heap_limits: DataFrame | None = None,
) -> DataFrame:
    """Every rule over the tables, as one table of diagnoses.

    The task table is aggregated once.  The result, one row per stage, feeds the stage rules, the
    parent notice, the skew flags and the out-of-memory report, so it is written to the shared
    folder: small next to the tasks, and safe when executors are lost.  Heap alerts compare with the
    configured executor memory; ``heap_limits`` (``app_id``, ``executor_memory``) overrides it.
    """
    sites = None if t.rdds is None else lineage.stage_callsites(t.rdds)
    stats = stages.stage_stats(t.tasks, eval_ms, th, hot_rows)
    described = materialise(rules.describe(stats, t.stages, sites), "stage-stats")

    found = [
        rules.all_stage_alerts(described, eval_ms, th, only_running),
        failures.failure_alerts(t.tasks),
    ]
    if "parent_ids" in t.stages.columns:
        found.append(rules.shuffle_read_notices(t.stages, described))
    if t.host_samples is not None:
        names = hosts.host_names(t.host_samples) if t.host_names is None else t.host_names
        stragglers = rules.unexplained_stragglers(described, eval_ms, th, only_running)
        state = hosts.host_state_asof(stragglers, names, t.host_samples)
        found.append(rules.straggler_alerts(stragglers, state))
    if t.app_conf is not None:
        known = failures.stage_context(described, applications.app_configs(t.app_conf), th)
        context = failures.failure_context(failures.oom_attempts(t.tasks), known)
        found.append(failures.oom_reports(context))
    if t.samples is not None:
        limits = applications.app_configs(t.app_conf) if heap_limits is None and t.app_conf is not None else heap_limits
        found.append(executors.heap_pressure(t.samples, limits, th))
    if t.polls is not None:
        found.append(executors.lost_executors(t.polls, t.samples, th))
    return stages.union_all(*[df.select(*DIAGNOSTIC_COLUMNS) for df in found])


def event_records(t: Telemetry, end_ms: int) -> DataFrame:
    """Records of the five lifecycle events, ready for the sinks."""
    parts = [
        sink_records.stage_records(stages.stage_summary(t.stages, t.tasks)),
        sink_records.failure_records(t.tasks),
    ]
    if t.executors is not None and t.samples is not None:
        rollup = executors.executor_rollup(t.executors, t.tasks, t.samples, end_ms)
        parts.append(sink_records.executor_records(rollup))
        if t.applications is not None and t.app_conf is not None:
            configs = applications.app_configs(t.app_conf)
            summary = applications.app_summary(t.applications, configs, t.executors, end_ms)
            parts += [sink_records.app_start_records(summary), sink_records.app_end_records(summary)]
    return stages.union_all(*parts)
