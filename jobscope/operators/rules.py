"""Diagnosis rules over stage statistics.

A rule is a condition and a message, in SQL, over one row of :func:`stages.stage_stats` joined with
the stage name and, for shuffle skew, the call site.  One rule alone is a filter, so Spark prunes the
statistics the rule does not read; all rules together are one pass that emits the fired ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import fmt_bytes_sql
from ..functions.text import message_sql, time_sql
from ..schemas import STAGE_KEYS
from ..settings import RULE_ORDER, Thresholds
from .stages import parent_shuffle, union_all

# Event name and message templates.
STAGE_DIAGNOSIS = "STAGE_DIAGNOSIS"
TEXTS = {
    "long_tail": "longTail task occurred in stage {stage_id} ({name}), max time: {time_max} ms, taskId: {time_task_id}",
    "shuffle_read_skew": (
        "shuffle read skew occurred in stage {stage_id} ({name}), "
        "max shuffle read records: {read_max}, taskId: {read_task_id}{site}"
    ),
    "shuffle_write_skew": (
        "shuffle write skew occurred in stage {stage_id} ({name}), "
        "max shuffle write records: {write_max}, taskId: {write_task_id}{site}"
    ),
    "input_skew": (
        "input skew occurred in stage {stage_id} ({name}), max input records: {input_max}, taskId: {input_task_id}"
    ),
    "gc_overhead": "task {stage_id}.{gc_task_id} GC overhead: running time:{gc_time} ms, gc time:{gc_max} ms",
    "unexplained_straggler": (
        "task {task_id} running on {host}, Load 1m: {load1}, Load 5m: {load5}, Load 15m: {load15} "
        "CPU usage: Map({usage})"
    ),
    "scheduler_delay": "stage {stage_id} average task time: {run}.0 ms, average delay {delay}.0 ms",
    "shuffle_read_notice": "stage {stage_id} ({name}) prepare to shuffle read {size}, total tasks: {num_tasks}",
}
SITE = ", site: {callsite}"
CPU_MODES = ["idle", "system", "user"]


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    fires: str

    @property
    def message(self) -> str:
        site = f"if(callsite IS NULL, '', {message_sql(SITE)})"
        return message_sql(TEXTS[self.name], site=site)

    def condition(self, only_running: bool) -> str:
        """With ``only_running`` a rule holds only if its own largest task is still running."""
        return f"({self.fires} AND {self.metric}_running)" if only_running else f"({self.fires})"

    def alert(self, eval_ms: int | str) -> list[str]:
        return [
            f"'{STAGE_DIAGNOSIS}' AS event", "'WARN' AS level", f"'{self.name}' AS rule",
            f"{self.metric}_task_id AS task_id", "string(NULL) AS executor_id",
            f"bigint({time_sql(eval_ms)}) AS eval_ms", f"{RULE_ORDER[self.name]} AS rule_ord",
            f"{self.message} AS message",
        ]


def gap_ratio(top: str, base: str) -> str:
    """Distance of the maximum from a base, relative to the base; 1 for a base of 0."""
    return f"if({base} = 0, 1D, try_divide(double({top} - {base}), double({base})))"


def _skewed(m: str, gap: int, ratio: float, p75_ratio: float) -> str:
    top, mid, p75 = f"{m}_max", f"{m}_mid", f"{m}_p75"
    return (
        f"{top} - {mid} > {gap} AND {gap_ratio(top, mid)} > {ratio!r}D AND {gap_ratio(top, p75)} > {p75_ratio!r}D"
    )


def task_rules(th: Thresholds = Thresholds()) -> dict[str, Rule]:
    """The rules about the largest task of a stage, in the order they are evaluated."""
    shuffle = (th.shuffle_gap_records, th.shuffle_skew_ratio, th.shuffle_skew_ratio / th.p75_divisor)
    source = (th.input_gap_records, th.input_skew_ratio, th.input_skew_ratio / th.p75_divisor)
    long_tail = (
        f"time_max - time_mid > {th.long_tail_gap_ms} AND {gap_ratio('time_max', 'time_mid')} > {th.long_tail_ratio!r}D"
    )
    gc = f"gc_max > {th.gc_ms} AND try_divide(double(gc_max), double(gc_time)) > {th.gc_ratio!r}D"
    rules = [
        Rule("long_tail", "time", long_tail),
        Rule("shuffle_read_skew", "read", _skewed("read", *shuffle)),
        Rule("shuffle_write_skew", "write", _skewed("write", *shuffle)),
        Rule("input_skew", "input", _skewed("input", *source)),
        Rule("gc_overhead", "gc", gc),
    ]
    return {rule.name: rule for rule in rules}


def with_sites(named: DataFrame, callsites: DataFrame | None = None) -> DataFrame:
    """Adds the call site of each stage, null where it is not known."""
    if callsites is None:
        return named.withColumn("callsite", F.lit(None).cast("string"))
    return named.join(callsites.select(*STAGE_KEYS, "callsite"), STAGE_KEYS, "left")


def describe(stats: DataFrame, stages: DataFrame, callsites: DataFrame | None = None) -> DataFrame:
    """Statistics with the stage name and, where known, the call site."""
    return with_sites(stats.join(stages.select(*STAGE_KEYS, "name"), STAGE_KEYS, "left"), callsites)


def one_rule(
    described: DataFrame, name: str, eval_ms: int | str, th: Thresholds = Thresholds(), only_running: bool = False
) -> DataFrame:
    """The alerts of a single rule."""
    rule = task_rules(th)[name]
    return described.filter(rule.condition(only_running)).selectExpr(*STAGE_KEYS, *rule.alert(eval_ms))


def task_alerts(
    described: DataFrame, eval_ms: int | str, th: Thresholds = Thresholds(), only_running: bool = False
) -> DataFrame:
    """The alerts of all task rules in one pass over the statistics."""
    fired = [
        f"if({rule.condition(only_running)}, struct({', '.join(rule.alert(eval_ms))}), NULL)"
        for rule in task_rules(th).values()
    ]
    return described.selectExpr(*STAGE_KEYS, f"inline(array_compact(array({', '.join(fired)})))")


def skew_flag(th: Thresholds = Thresholds()) -> str:
    """SQL of the last skew message of a stage, else null; write skew sets none."""
    rules = task_rules(th)
    cases = " ".join(
        f"WHEN {rules[name].fires} THEN {rules[name].message}" for name in ("input_skew", "shuffle_read_skew")
    )
    return f"CASE {cases} END"


def unexplained_stragglers(
    stats: DataFrame, eval_ms: int | str, th: Thresholds = Thresholds(), only_running: bool = False
) -> DataFrame:
    """``(stage, task_id, host, eval_ms)`` of long-tail tasks no other fired rule points at."""
    rules = task_rules(th)
    explained = " OR ".join(
        f"coalesce({rule.condition(only_running)}, false) AND {rule.metric}_task_id = time_task_id"
        for name, rule in rules.items() if name != "long_tail"
    )
    condition = f"{rules['long_tail'].condition(only_running)} AND time_host <> '' AND NOT ({explained})"
    return stats.filter(condition).selectExpr(
        *STAGE_KEYS, "time_task_id AS task_id", "time_host AS host", f"bigint({time_sql(eval_ms)}) AS eval_ms"
    )


def _stage_alert(df: DataFrame, rule: str, level: str, task: str, eval_ms: str, message: str) -> DataFrame:
    return df.selectExpr(
        *STAGE_KEYS, f"'{STAGE_DIAGNOSIS}' AS event", f"'{level}' AS level", f"'{rule}' AS rule",
        f"{task} AS task_id", "string(NULL) AS executor_id", f"bigint({eval_ms}) AS eval_ms",
        f"{RULE_ORDER[rule]} AS rule_ord", f"{message} AS message",
    )


def straggler_alerts(stragglers: DataFrame, host_state: DataFrame) -> DataFrame:
    """Unexplained stragglers with the state of their host; what is unknown is left empty.

    ``host_state``: ``(host, eval_ms, load1, load5, load15, idle, system, user)``.
    """
    def number(name: str) -> str:
        return f"if({name} IS NULL, NULL, format_string('%.6f', {name}))"

    modes = ", ".join(f"concat('{m} -> ', {number(f'`{m}`')})" for m in CPU_MODES)
    loads = {name: number(name) for name in ("load1", "load5", "load15")}
    message = message_sql(TEXTS["unexplained_straggler"], usage=f"concat_ws(', ', {modes})", **loads)
    known = stragglers.join(host_state, ["host", "eval_ms"], "left")
    return _stage_alert(known, "unexplained_straggler", "INFO", "task_id", "eval_ms", message)


def scheduler_delay_alerts(stats: DataFrame, eval_ms: int | str, th: Thresholds = Thresholds()) -> DataFrame:
    """Delay quantiles that sum up to a large share of the run-time quantiles.

    No run time at all fires when there is any delay, and does not when there is none.
    """
    run, delay = (f"aggregate({m}_five, 0L, (a, b) -> a + b)" for m in ("run", "delay"))
    share = f"try_divide(double({delay}), double({run}))"
    heavy = stats.filter(f"if({run} = 0, {delay} > 0, {share} > {th.scheduler_delay_ratio!r}D)")
    message = message_sql(TEXTS["scheduler_delay"], run="run_five[2]", delay="delay_five[2]")
    return _stage_alert(heavy, "scheduler_delay", "WARN", "bigint(NULL)", time_sql(eval_ms), message)


def shuffle_read_notices(stages: DataFrame, written: DataFrame) -> DataFrame:
    """What a stage is about to read from its parents, at its submission."""
    found = parent_shuffle(stages, written)
    message = message_sql(TEXTS["shuffle_read_notice"], size=fmt_bytes_sql("parent_shuffle_bytes"))
    return _stage_alert(found, "shuffle_read_notice", "INFO", "bigint(NULL)", "submission_ms", message)


def all_stage_alerts(
    described: DataFrame, eval_ms: int | str, th: Thresholds = Thresholds(), only_running: bool = False
) -> DataFrame:
    """Task rules and scheduling delay, which is judged at stage completion only."""
    alerts = task_alerts(described, eval_ms, th, only_running)
    if only_running:
        return alerts
    return union_all(alerts, scheduler_delay_alerts(described, eval_ms, th))
