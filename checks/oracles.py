"""The expected results, as DuckDB SQL over the same tables.

Written from the rules, not from the Spark code: argmax by ordered ``first``, rates by self-contained
window queries, lineage by a recursive CTE.
"""

from __future__ import annotations

from .fixtures import EVAL_MS, HALF_MS, with_views

E = EVAL_MS


def fmt_bytes(x: str) -> str:
    scaled = "\n".join(
        f"WHEN {x} < {1024 ** (p + 1)} THEN printf('%.2f', {x} / {float(1024 ** p)}) || ' {u}'"
        for p, u in ((1, "KB"), (2, "MB"), (3, "GB"))
    )
    return (
        f"(CASE WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || ' B'\n{scaled}\n"
        f"ELSE printf('%.2f', {x} / {float(1024 ** 4)}) || ' TB' END)"
    )


def fmt_duration(x: str) -> str:
    parts = [(86400000, 10**9, "day"), (3600000, 24, "hour"), (60000, 60, "mins"), (1000, 60, "secs")]
    words = " || ".join(
        f"(CASE WHEN ({x} // {size}) % {mod} > 0 THEN (({x} // {size}) % {mod}) || ' {unit} ' ELSE '' END)"
        for size, mod, unit in parts
    )
    return f"(CASE WHEN {x} < 1000 THEN {x} || ' ms' ELSE {words} END)"


def advice(x: str) -> str:
    return f"""(CASE WHEN {x} LIKE '%Exit code is 143%' THEN 'reason: data skew or too large, solutions: check if data is skewed or boost spark.executor.memoryOverhead'
 WHEN {x} LIKE '%spark.shuffle.FetchFailedException%' AND {x} LIKE '%Failed to connect to%' THEN 'reason: shuffle read data too large, solutions: 1) boost spark.executor.memory 2) boost spark.executor.cores 3) boost spark.network.timeout 4) check if data is skewed 5) avoid to use shuffle transformations if possible'
 WHEN {x} LIKE '%ExecutorLostFailure%' THEN 'reason: network problem or task gc overhead, solutions: boost spark.network.timeout'
 ELSE '' END)"""


def clock(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d %H:%M:%S.%g')"


def _ratio(m: str, base: str) -> str:
    return f"(CASE WHEN {base} = 0 THEN 1e0 ELSE ({m} - {base}) * 1e0 / nullif({base}, 0) END)"


def _skew(m: str, gap: int, ratio: str) -> str:
    return (
        f"({m}_max - {m}_mid > {gap} AND {_ratio(f'{m}_max', f'{m}_mid')} > {ratio}"
        f" AND {_ratio(f'{m}_max', f'{m}_p75')} > {ratio} / 1.5e0)"
    )


FIRES = {
    "long_tail": f"(time_max - time_mid > 20000 AND {_ratio('time_max', 'time_mid')} > 0.6e0)",
    "shuffle_read_skew": _skew("read", 2000, "0.4e0"),
    "shuffle_write_skew": _skew("write", 2000, "0.4e0"),
    "input_skew": _skew("input", 5000, "0.6e0"),
    "gc_overhead": "(gc_max > 20000 AND gc_max * 1e0 / nullif(gc_time, 0) > 0.7e0)",
}
METRIC = {
    "long_tail": "time", "shuffle_read_skew": "read", "shuffle_write_skew": "write",
    "input_skew": "input", "gc_overhead": "gc",
}
ORDER = {"long_tail": 1, "shuffle_read_skew": 2, "shuffle_write_skew": 3, "input_skew": 4, "gc_overhead": 5}
SITE = "(CASE WHEN callsite IS NULL THEN '' ELSE ', site: ' || callsite END)"
MESSAGE = {
    "long_tail": "'longTail task occurred in stage ' || stage_id || ' (' || name || '), max time: ' || time_max || ' ms, taskId: ' || time_task_id",
    "shuffle_read_skew": f"'shuffle read skew occurred in stage ' || stage_id || ' (' || name || '), max shuffle read records: ' || read_max || ', taskId: ' || read_task_id || {SITE}",
    "shuffle_write_skew": f"'shuffle write skew occurred in stage ' || stage_id || ' (' || name || '), max shuffle write records: ' || write_max || ', taskId: ' || write_task_id || {SITE}",
    "input_skew": "'input skew occurred in stage ' || stage_id || ' (' || name || '), max input records: ' || input_max || ', taskId: ' || input_task_id",
    "gc_overhead": "'task ' || stage_id || '.' || gc_task_id || ' GC overhead: running time:' || gc_time || ' ms, gc time:' || gc_max || ' ms'",
}


def rule(name: str, running: bool = False, source: str = "ox_described") -> str:
    gate = f" AND {METRIC[name]}_running" if running else ""
    return (
        f"SELECT app_id, 'STAGE_DIAGNOSIS' AS event, 'WARN' AS level, '{name}' AS rule, stage_id, stage_attempt_id, "
        f"{METRIC[name]}_task_id AS task_id, CAST(NULL AS VARCHAR) AS executor_id, CAST({E} AS BIGINT) AS eval_ms, "
        f"{ORDER[name]} AS rule_ord, {MESSAGE[name]} AS message FROM {source} WHERE {FIRES[name]}{gate}"
    )


def _first(m: str, cond: str, what: str) -> str:
    return f"first({what} ORDER BY {m} DESC, time_ms DESC, task_id) FILTER (WHERE {m} > 0 AND {cond})"


def _top(name: str, m: str, cond: str = "true") -> str:
    return (
        f"coalesce({_first(m, cond, 'task_id')}, -1) AS {name}_task_id, "
        f"coalesce({_first(m, cond, 'running')}, false) AS {name}_running"
    )


def _q(m: str, p: float, cond: str = "true") -> str:
    return f"CAST(coalesce(floor(quantile_cont({m}, {p}) FILTER (WHERE {cond})), 0) AS BIGINT)"


def _five(m: str, i: int, q: float) -> str:
    return f"{m}_list[CAST(least(floor({q} * len({m}_list)), len({m}_list) - 1) AS BIGINT) + 1]"


QS = [("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0)]
GC_COND = "gc_ms > 1000 AND time_ms > 10000"
OOM = "failure_reason LIKE '%Exit code is 143%'"
CPU_MODES = "('system', 'idle', 'user')"
TASK_FAILED_TEXT = (
    "'task ' || stage_id || '.' || task_id || ' failed, reason: ' || failure_reason || ', running on executor ' || executor_id"
)
STATS_COLUMNS = (
    "app_id, stage_id, stage_attempt_id, n_tasks, time_min, time_mid, time_max, input_min, input_mid, input_p75, "
    "input_max, read_min, read_mid, read_p75, read_max, write_min, write_mid, write_p75, write_max"
)


def _series_at(samples: str) -> str:
    """Both rates per series and evaluation time, from samples placed under evaluation times."""
    step = "CASE WHEN value >= before_value THEN value - before_value ELSE value END"
    return f"""
SELECT instance, metric, mode, cpu, eval_ms,
  sum(CASE WHEN before_ms > eval_ms - 5000 THEN {step} END)
    / nullif((max(ts_ms) FILTER (WHERE ts_ms > eval_ms - 5000) - min(ts_ms) FILTER (WHERE ts_ms > eval_ms - 5000)) / 1000e0, 0) AS rate,
  max(CASE WHEN rn = 1 THEN {step} END) / nullif(max(CASE WHEN rn = 1 THEN ts_ms - before_ms END) / 1000e0, 0) AS irate
FROM (SELECT *, lag(ts_ms) OVER w AS before_ms, lag(value) OVER w AS before_value,
        row_number() OVER (PARTITION BY instance, metric, mode, cpu, eval_ms ORDER BY ts_ms DESC) AS rn
      FROM {samples} WINDOW w AS (PARTITION BY instance, metric, mode, cpu, eval_ms ORDER BY ts_ms))
GROUP BY instance, metric, mode, cpu, eval_ms"""


CPU_USAGE = (
    "round(coalesce(sum(rate), sum(irate)) * 100 / count(*), 6)"
)

def _config(sizes: str, name: str, conf: str) -> dict[str, str]:
    """Settings of each application, from its keys and values."""
    return {
        sizes: f"""
SELECT app_id, key, value, CASE WHEN value LIKE '%g' THEN TRY_CAST(replace(value, 'g', '') AS BIGINT) * 1073741824
  WHEN value LIKE '%m' THEN TRY_CAST(replace(value, 'm', '') AS BIGINT) * 1048576 ELSE try_cast(value AS BIGINT) END AS bytes FROM {conf}""",
        name: f"""
SELECT app_id, CAST(coalesce(max(bytes) FILTER (WHERE key = 'spark.driver.memory'), 1073741824) AS BIGINT) AS driver_memory,
  CAST(coalesce(max(bytes) FILTER (WHERE key = 'spark.executor.memory'), 1073741824) AS BIGINT) AS executor_memory,
  coalesce(max(TRY_CAST(value AS INT)) FILTER (WHERE key = 'spark.executor.cores'), 1) AS executor_cores,
  coalesce(max(TRY_CAST(value AS INT)) FILTER (WHERE key = 'spark.sql.shuffle.partitions'), 200) AS shuffle_partitions,
  CASE WHEN bool_or(key = 'spark.dynamicAllocation.enabled' AND value = 'true')
    THEN coalesce(max(TRY_CAST(value AS INT)) FILTER (WHERE key = 'spark.dynamicAllocation.maxExecutors'), 5) END AS max_dynamic_executors,
  CASE WHEN NOT bool_or(key = 'spark.dynamicAllocation.enabled' AND value = 'true')
    THEN coalesce(max(TRY_CAST(value AS INT)) FILTER (WHERE key = 'spark.executor.instances'), 5) END AS executor_instances
FROM {sizes} GROUP BY app_id""",
    }


VIEWS = {
    "ox_m": f"""
SELECT *, status = 'RUNNING' AS running,
  CASE WHEN status = 'RUNNING' THEN {E} - launch_ms ELSE coalesce(duration_ms, 0) END AS time_ms FROM fx_tasks""",
    "ox_t": """
SELECT *, (status = 'SUCCESS' OR (status <> 'FAILED' AND time_ms > 10000)) AS eligible,
  greatest(0, coalesce(duration_ms, 0) - run_ms - deserialize_ms - result_ser_ms - getting_result_ms) AS delay_ms FROM ox_m""",
    "ox_stats": f"""
SELECT app_id, stage_id, stage_attempt_id, count(*) AS n_tasks, count(*) FILTER (WHERE status <> 'RUNNING') AS n_finished,
  min(time_ms) AS time_min, {_q('time_ms', 0.5)} AS time_mid, max(time_ms) AS time_max,
  coalesce(min(input_records) FILTER (WHERE eligible), 0) AS input_min,
  CAST(coalesce(sum(input_records) FILTER (WHERE eligible) // nullif(count(*) FILTER (WHERE eligible), 0), 0) AS BIGINT) AS input_mid,
  {_q('input_records', 0.75, 'eligible')} AS input_p75, coalesce(max(input_records) FILTER (WHERE eligible), 0) AS input_max,
  min(shuffle_read_records) AS read_min, {_q('shuffle_read_records', 0.5)} AS read_mid,
  {_q('shuffle_read_records', 0.75)} AS read_p75, max(shuffle_read_records) AS read_max,
  min(shuffle_write_records) AS write_min, {_q('shuffle_write_records', 0.5)} AS write_mid,
  {_q('shuffle_write_records', 0.75)} AS write_p75, max(shuffle_write_records) AS write_max,
  {_top('time', 'time_ms')}, {_top('input', 'input_records', 'eligible')},
  {_top('read', 'shuffle_read_records')}, {_top('write', 'shuffle_write_records')}, {_top('gc', 'gc_ms', GC_COND)},
  coalesce({_first('time_ms', 'true', 'host')}, '') AS time_host,
  coalesce(max(gc_ms) FILTER (WHERE {GC_COND}), 0) AS gc_max,
  coalesce({_first('gc_ms', GC_COND, 'time_ms')}, 0) AS gc_time,
  CAST(coalesce(sum(input_bytes) FILTER (WHERE status <> 'FAILED'), 0) AS BIGINT) AS input_bytes,
  CAST(coalesce(sum(output_bytes) FILTER (WHERE status <> 'FAILED'), 0) AS BIGINT) AS output_bytes,
  CAST(coalesce(sum(shuffle_local_bytes + shuffle_remote_bytes) FILTER (WHERE status <> 'FAILED'), 0) AS BIGINT) AS shuffle_read_bytes,
  CAST(coalesce(sum(shuffle_write_bytes) FILTER (WHERE status <> 'FAILED'), 0) AS BIGINT) AS shuffle_write_bytes,
  list_sort(list(run_ms) FILTER (WHERE status = 'SUCCESS')) AS run_list,
  list_sort(list(delay_ms) FILTER (WHERE status = 'SUCCESS')) AS delay_list
FROM ox_t GROUP BY app_id, stage_id, stage_attempt_id""",
    "ox_edges": """
SELECT e.stage_id, e.rdd_id, count(*) AS n, count(r.rdd_id) AS inside, min(e.parent_id) AS parent_id
FROM fx_rdd_parents e LEFT JOIN fx_rdds r ON r.stage_id = e.stage_id AND r.rdd_id = e.parent_id
GROUP BY e.stage_id, e.rdd_id""",
    "ox_next": "SELECT stage_id, rdd_id, parent_id FROM ox_edges WHERE n = 1 AND inside = 1",
    "ox_walk": """
SELECT stage_id, max(rdd_id) AS rdd_id FROM fx_rdds GROUP BY stage_id
UNION ALL SELECT w.stage_id, n.parent_id FROM ox_walk w JOIN ox_next n ON n.stage_id = w.stage_id AND n.rdd_id = w.rdd_id""",
    "ox_sites": """
SELECT 'app_' || (s.stage_id % 4) AS app_id, s.stage_id, 0 AS stage_attempt_id, r.rdd_id, r.callsite
FROM (SELECT stage_id, rdd_id FROM ox_walk ANTI JOIN ox_next USING (stage_id, rdd_id)) s
JOIN fx_rdds r ON r.stage_id = s.stage_id AND r.rdd_id = s.rdd_id""",
    "ox_described": """
SELECT s.*, g.name, c.callsite FROM ox_stats s JOIN fx_stages g USING (app_id, stage_id, stage_attempt_id)
LEFT JOIN ox_sites c USING (app_id, stage_id, stage_attempt_id)""",
    "ox_plain": """
SELECT s.*, g.name, CAST(NULL AS VARCHAR) AS callsite FROM ox_stats s JOIN fx_stages g USING (app_id, stage_id, stage_attempt_id)""",
    "ox_task_alerts": "\nUNION ALL ".join(rule(r) for r in FIRES),
    "ox_flags": f"""
SELECT app_id, stage_id, stage_attempt_id, CASE WHEN {FIRES['input_skew']} THEN {MESSAGE['input_skew']}
  WHEN {FIRES['shuffle_read_skew']} THEN {MESSAGE['shuffle_read_skew']} END AS skew_flag FROM ox_described""",
    "ox_stragglers": f"""
SELECT app_id, stage_id, stage_attempt_id, time_task_id AS task_id, time_host AS host, CAST({E} AS BIGINT) AS eval_ms
FROM ox_stats WHERE {FIRES['long_tail']} AND time_host <> ''
""" + "".join(
        f" AND NOT (coalesce({FIRES[r]}, false) AND {METRIC[r]}_task_id = time_task_id)" for r in list(FIRES)[1:]
    ),
    "ox_parents": """
SELECT s.app_id, s.stage_id, s.stage_attempt_id, s.name, s.num_tasks, s.submission_ms, sum(w.shuffle_write_bytes) AS parent_shuffle_bytes
FROM fx_stages s JOIN fx_stage_parents p ON p.app_id = s.app_id AND p.stage_id = s.stage_id JOIN ox_stats w ON w.app_id = p.app_id AND w.stage_id = p.parent_id
GROUP BY ALL HAVING sum(w.shuffle_write_bytes) > 0""",
    **_config("ox_size", "ox_config", "fx_conf"),
    **_config("ox_set_size", "ox_settings", "fx_settings"),
    "ox_heap": """
SELECT app_id, executor_id, min(heap_used) AS min_heap, max(heap_used) AS max_heap, CAST(sum(heap_used) AS BIGINT) AS total_heap,
  count(*) AS samples, CAST(sum(heap_used) // count(*) AS BIGINT) AS avg_heap FROM fx_samples GROUP BY app_id, executor_id""",
    "ox_rollup": f"""
SELECT e.app_id, e.executor_id, e.host, coalesce(e.removed_ms, {E}) - e.added_ms AS elapsed_ms, coalesce(e.removed_ms, {E}) AS eval_ms,
  coalesce(t.completed_tasks, 0) AS completed_tasks, coalesce(t.failed_tasks, 0) AS failed_tasks,
  CAST(coalesce(t.input_bytes, 0) AS BIGINT) AS input_bytes, CAST(coalesce(t.shuffle_read_bytes, 0) AS BIGINT) AS shuffle_read_bytes,
  coalesce(h.avg_heap, 0) AS avg_heap, coalesce(h.max_heap, 0) AS max_heap
FROM fx_executors e
LEFT JOIN (SELECT app_id, executor_id, count(*) FILTER (WHERE status = 'SUCCESS') AS completed_tasks,
    count(*) FILTER (WHERE status = 'FAILED') AS failed_tasks, sum(input_bytes) AS input_bytes,
    sum(shuffle_local_bytes + shuffle_remote_bytes) AS shuffle_read_bytes FROM fx_tasks GROUP BY ALL) t
  ON t.app_id = e.app_id AND t.executor_id = e.executor_id
LEFT JOIN ox_heap h ON h.app_id = e.app_id AND h.executor_id = e.executor_id
WHERE e.executor_id <> 'driver'""",
    "ox_app": f"""
SELECT a.app_id, a.user_name, a.queue, a.submit_ms, a.start_ms, CAST({E} AS BIGINT) AS end_ms, {E} - a.start_ms AS elapsed_ms,
  c.driver_memory, c.executor_memory, c.executor_cores, c.shuffle_partitions, c.max_dynamic_executors, c.executor_instances,
  CAST(r.alive * (c.executor_memory // 1048576) AS BIGINT) AS memory_seconds, CAST(r.cores AS BIGINT) AS vcore_seconds
FROM fx_apps a JOIN ox_config c ON c.app_id = a.app_id
JOIN (SELECT app_id, sum((coalesce(removed_ms, {E}) - added_ms) // 1000) AS alive,
        sum((coalesce(removed_ms, {E}) - added_ms) // 1000 * cores) AS cores FROM fx_executors GROUP BY app_id) r ON r.app_id = a.app_id""",
    "ox_stage_done": f"""
SELECT g.app_id, g.stage_id, g.stage_attempt_id, g.completion_ms - g.submission_ms AS elapsed_ms, g.num_tasks,
  s.input_bytes, s.output_bytes, s.shuffle_read_bytes, s.shuffle_write_bytes, g.completion_ms AS eval_ms
FROM fx_stages g JOIN ox_stats s USING (app_id, stage_id, stage_attempt_id)
WHERE g.completion_ms IS NOT NULL AND g.failure_reason IS NULL""",
    "ox_failed": "SELECT * FROM fx_tasks WHERE status IN ('FAILED', 'KILLED')",
    "ox_context": """
SELECT f.app_id, f.stage_id, f.stage_attempt_id, f.task_id, f.executor_id, f.finish_ms, f.failure_reason,
  s.input_bytes, s.shuffle_read_bytes, k.skew_flag, coalesce(c.executor_memory, 1073741824) AS executor_memory
FROM ox_failed f LEFT JOIN ox_stats s USING (app_id, stage_id, stage_attempt_id)
LEFT JOIN ox_flags k USING (app_id, stage_id, stage_attempt_id) LEFT JOIN ox_config c USING (app_id)""",
    "ox_heap_alerts": f"""
SELECT app_id, 'EXECUTOR_INFO' AS event, 'WARN' AS level, 'heap_pressure' AS rule, CAST(NULL AS INT) AS stage_id,
  CAST(NULL AS INT) AS stage_attempt_id, CAST(NULL AS BIGINT) AS task_id, executor_id, ts_ms AS eval_ms, 11 AS rule_ord,
  'executor_' || executor_id || ' max memory is ' || {fmt_bytes('lim')} || ', current heap memory is ' || {fmt_bytes('heap_used')} AS message
FROM (SELECT s.*, coalesce(c.executor_memory, 1073741824) AS lim FROM fx_samples s LEFT JOIN ox_config c USING (app_id))
WHERE heap_used * 1e0 / lim > 0.9e0""",
    "ox_nth_poll": """
SELECT app_id, executor_id, ts_ms, row_number() OVER (PARTITION BY app_id, executor_id ORDER BY ts_ms) AS nth FROM fx_polls WHERE NOT ok""",
    "ox_lost": f"""
SELECT p.app_id, 'EXECUTOR_INFO' AS event, 'ERROR' AS level, 'executor_lost' AS rule, CAST(NULL AS INT) AS stage_id,
  CAST(NULL AS INT) AS stage_attempt_id, CAST(NULL AS BIGINT) AS task_id, p.executor_id, p.ts_ms AS eval_ms, 12 AS rule_ord,
  'lost executor_' || p.executor_id || ' 3 times, jvm info: ' || coalesce('min heap memory: ' || {fmt_bytes('min_heap')} ||
    '; average heap memory: ' || {fmt_bytes('avg_heap')} || '; max heap memory: ' || {fmt_bytes('max_heap')} || ' ', '') AS message
FROM ox_nth_poll p LEFT JOIN ox_heap h USING (app_id, executor_id) WHERE p.nth = 3""",
    "ox_delay": f"""
SELECT app_id, 'STAGE_DIAGNOSIS' AS event, 'WARN' AS level, 'scheduler_delay' AS rule, stage_id, stage_attempt_id,
  CAST(NULL AS BIGINT) AS task_id, CAST(NULL AS VARCHAR) AS executor_id, CAST({E} AS BIGINT) AS eval_ms, 7 AS rule_ord,
  'stage ' || stage_id || ' average task time: ' || run_median || '.0 ms, average delay ' || delay_median || '.0 ms' AS message
FROM (SELECT *, {' + '.join(_five('run', i, q) for i, (_, q) in enumerate(QS))} AS run_total,
        {' + '.join(_five('delay', i, q) for i, (_, q) in enumerate(QS))} AS delay_total,
        {_five('run', 2, 0.5)} AS run_median, {_five('delay', 2, 0.5)} AS delay_median FROM ox_stats)
WHERE CASE WHEN run_total = 0 THEN delay_total > 0 ELSE delay_total * 1e0 / run_total > 0.2e0 END""",
    "ox_notice": f"""
SELECT app_id, 'STAGE_DIAGNOSIS' AS event, 'INFO' AS level, 'shuffle_read_notice' AS rule, stage_id, stage_attempt_id,
  CAST(NULL AS BIGINT) AS task_id, CAST(NULL AS VARCHAR) AS executor_id, submission_ms AS eval_ms, 0 AS rule_ord,
  'stage ' || stage_id || ' (' || name || ') prepare to shuffle read ' || {fmt_bytes('parent_shuffle_bytes')} || ', total tasks: ' || num_tasks AS message
FROM ox_parents""",
    "ox_events": f"""
SELECT app_id, 'TASK_FAILED' AS event, 'ERROR' AS level, 'task_failed' AS rule, stage_id, stage_attempt_id, task_id, executor_id,
  finish_ms AS eval_ms, 8 AS rule_ord, {TASK_FAILED_TEXT} AS message FROM ox_failed""",
    "ox_causes": f"""
SELECT app_id, 'TASK_DIAGNOSIS' AS event, 'ERROR' AS level, 'task_failure_cause' AS rule, stage_id, stage_attempt_id, task_id, executor_id,
  finish_ms AS eval_ms, 9 AS rule_ord, 'task ' || task_id || ' failed: ' || failure_reason || ' ' || {advice('failure_reason')} AS message
FROM ox_failed WHERE NOT ({OOM})""",
    "ox_oom": f"""
SELECT app_id, 'TASK_DIAGNOSIS' AS event, 'ERROR' AS level, 'oom_report' AS rule, stage_id, stage_attempt_id, task_id, executor_id,
  finish_ms AS eval_ms, 10 AS rule_ord, 'executor ' || executor_id ||
  ' failed due to OOM, possible reasons: 1) data skew 2)executor memory too low 3)reading too large data' || chr(10) ||
  'current executor memory: ' || {fmt_bytes('executor_memory')} ||
  (CASE WHEN input_bytes > 0 THEN chr(10) || 'stage_' || stage_id || ' input data: ' || {fmt_bytes('input_bytes')} ELSE '' END) ||
  (CASE WHEN shuffle_read_bytes > 0 THEN chr(10) || 'stage_' || stage_id || ' shuffle read data: ' || {fmt_bytes('shuffle_read_bytes')} ELSE '' END) ||
  coalesce(chr(10) || skew_flag, '') AS message
FROM ox_context WHERE {OOM}""",
    "ox_names": "SELECT nodename AS host, min(instance) AS instance FROM fx_host_names GROUP BY nodename",
    "ox_hosts": "SELECT DISTINCT host FROM fx_executors",
    "ox_ticks": """
SELECT *, CAST(ceil(ts_ms / 300000e0) AS BIGINT) * 300000 AS eval_ms FROM fx_host_samples""",
    "ox_latest": """
SELECT n.host, t.eval_ms, t.metric, max_by(t.value, t.ts_ms) AS value FROM ox_ticks t JOIN ox_names n USING (instance)
JOIN ox_hosts h ON h.host = n.host GROUP BY ALL""",
    "ox_cpu_ticks": f"SELECT * FROM ox_ticks WHERE metric = 'node_cpu' AND mode IN {CPU_MODES}",
    "ox_cpu_series": _series_at("ox_cpu_ticks"),
    "ox_io_ticks": "SELECT * FROM ox_ticks WHERE metric IN ('node_vmstat_pgpgin', 'node_vmstat_pgpgout')",
    "ox_io_series": _series_at("ox_io_ticks"),
    # Stragglers at their evaluation time, and stragglers spread over the time the host samples span.
    "ox_probes": f"""
SELECT app_id, stage_id, stage_attempt_id, task_id, host,
  CAST({E} - (47 - stage_id) * CAST(floor((SELECT max(event_id) FROM events) * 1000 / 48) AS BIGINT) AS BIGINT) AS eval_ms FROM ox_stragglers""",
}


def _state(probes: str, tag: str) -> dict[str, str]:
    """Host state at the time of each probe."""
    return {
        f"ox_seen_{tag}": f"""
SELECT p.host, p.eval_ms, s.* FROM (SELECT DISTINCT host, eval_ms FROM {probes}) p JOIN ox_names n ON n.host = p.host
JOIN fx_host_clock s ON s.instance = n.instance AND s.ts_ms <= p.eval_ms AND s.ts_ms > p.eval_ms - 300000""",
        f"ox_loads_{tag}": f"""
SELECT host, eval_ms, max_by(value, ts_ms) FILTER (WHERE metric = 'node_load1') AS load1,
  max_by(value, ts_ms) FILTER (WHERE metric = 'node_load5') AS load5,
  max_by(value, ts_ms) FILTER (WHERE metric = 'node_load15') AS load15 FROM ox_seen_{tag} GROUP BY host, eval_ms""",
        f"ox_seen_cpu_{tag}": f"SELECT * FROM ox_seen_{tag} WHERE metric = 'node_cpu' AND mode IN {CPU_MODES}",
        f"ox_series_{tag}": _series_at(f"ox_seen_cpu_{tag}"),
        f"ox_usage_{tag}": f"""
SELECT n.host, u.eval_ms, max(usage) FILTER (WHERE mode = 'system') AS system, max(usage) FILTER (WHERE mode = 'idle') AS idle,
  max(usage) FILTER (WHERE mode = 'user') AS "user"
FROM (SELECT instance, eval_ms, mode, {CPU_USAGE} AS usage FROM ox_series_{tag} GROUP BY instance, eval_ms, mode) u
JOIN ox_names n ON n.instance = u.instance GROUP BY n.host, u.eval_ms""",
        f"ox_state_{tag}": f"""
SELECT p.*, l.load1, l.load5, l.load15, u.system, u.idle, u."user" FROM {probes} p
LEFT JOIN ox_loads_{tag} l ON l.host = p.host AND l.eval_ms = p.eval_ms
LEFT JOIN ox_usage_{tag} u ON u.host = p.host AND u.eval_ms = p.eval_ms""",
    }


VIEWS |= _state("ox_stragglers", "now") | _state("ox_probes", "asof")
_number = "coalesce(printf('%.6f', {0}), '')".format
_mode = "CASE WHEN {0} IS NOT NULL THEN '{1} -> ' || printf('%.6f', {0}) END".format
VIEWS |= {
    "ox_straggler_alerts": f"""
SELECT app_id, 'STAGE_DIAGNOSIS' AS event, 'INFO' AS level, 'unexplained_straggler' AS rule, stage_id, stage_attempt_id, task_id,
  CAST(NULL AS VARCHAR) AS executor_id, eval_ms, 6 AS rule_ord,
  'task ' || task_id || ' running on ' || host || ', Load 1m: ' || {_number('load1')} || ', Load 5m: ' || {_number('load5')} ||
  ', Load 15m: ' || {_number('load15')} || ' CPU usage: Map(' ||
  concat_ws(', ', {_mode('idle', 'idle')}, {_mode('system', 'system')}, {_mode('"user"', 'user')}) || ')' AS message
FROM ox_state_now""",
    "ox_all": "\nUNION ALL ".join(
        f"SELECT * FROM {v}"
        for v in ("ox_task_alerts", "ox_straggler_alerts", "ox_delay", "ox_notice", "ox_events", "ox_causes",
                  "ox_oom", "ox_heap_alerts", "ox_lost")
    ),
    # Records for the sinks: console text, JSON body, Graphite points.
    "ox_records": f"""
SELECT app_id, 'APP_START' AS event, 'INFO' AS level, start_ms AS eval_ms, 'appId: ' || app_id || ', configuration: driverMemory: ' ||
  {fmt_bytes('driver_memory')} || ', executorMemory: ' || {fmt_bytes('executor_memory')} || ', executorCores: ' || executor_cores ||
  ', shufflePartitions: ' || shuffle_partitions || coalesce(', maxDynamicExecutors: ' || max_dynamic_executors, '') ||
  coalesce(', executorInstances: ' || executor_instances, '') AS text,
  '{{"appId":"' || app_id || '","submitTime":' || submit_ms || ',"startTime":' || start_ms || ',"user":"' || user_name || '","queue":"' || queue ||
  '","configuration":{{"driverMemory":' || driver_memory || ',"executorMemory":' || executor_memory || ',"executorCores":' || executor_cores ||
  ',"shufflePartitions":' || shuffle_partitions || coalesce(',"maxDynamicExecutors":' || max_dynamic_executors, '') ||
  coalesce(',"executorInstances":' || executor_instances, '') || '}}}}' AS body,
  app_id || '_APP_START' AS prefix, ['submitTime ' || submit_ms, 'startTime ' || start_ms, 'user ' || user_name, 'queue ' || queue] AS points
FROM ox_app
UNION ALL SELECT app_id, 'APP_END', 'INFO', end_ms, app_id || ' end, elapsed time: ' || {fmt_duration('elapsed_ms')} ||
  ' memorySeconds: ' || memory_seconds || ', vCoreSeconds: ' || vcore_seconds,
  '{{"appId":"' || app_id || '","elapseTime":' || elapsed_ms || ',"memorySeconds":' || memory_seconds || ',"vCoreSeconds":' || vcore_seconds || '}}',
  app_id || '_APP_END', ['elapseTime ' || elapsed_ms, 'memorySeconds ' || memory_seconds, 'vCoreSeconds ' || vcore_seconds] FROM ox_app
UNION ALL SELECT app_id, 'STAGE_COMPLETED', 'INFO', eval_ms, 'stage ' || stage_id || ' complete, time: ' || {fmt_duration('elapsed_ms')} ||
  ', totalTask: ' || num_tasks || ', input: ' || {fmt_bytes('input_bytes')} || ', output: ' || {fmt_bytes('output_bytes')} ||
  ', shuffleRead: ' || {fmt_bytes('shuffle_read_bytes')} || ', shuffleWrite: ' || {fmt_bytes('shuffle_write_bytes')},
  '{{"appId":"' || app_id || '","elapseTime":' || elapsed_ms || ',"stageId":' || stage_id || ',"totalTask":' || num_tasks ||
  ',"inputBytes":' || input_bytes || ',"outputBytes":' || output_bytes || ',"shuffleReadBytes":' || shuffle_read_bytes ||
  ',"shuffleWriteBytes":' || shuffle_write_bytes || '}}', app_id || '_STAGE_COMPLETED_stage' || stage_id,
  ['totalTask ' || num_tasks, 'inputBytes ' || input_bytes, 'outputBytes ' || output_bytes,
   'shuffleReadBytes ' || shuffle_read_bytes, 'shuffleWriteBytes ' || shuffle_write_bytes] FROM ox_stage_done
UNION ALL SELECT app_id, 'TASK_FAILED', 'ERROR', finish_ms, {TASK_FAILED_TEXT},
  '{{"appId":"' || app_id || '","stageId":' || stage_id || ',"taskId":' || task_id || ',"executorId":"' || executor_id ||
  '","failedReason":"' || failure_reason || '"}}', app_id || '_TASK_FAILED_stage' || stage_id || '_' || task_id,
  ['executorId ' || executor_id, 'failedReason ' || failure_reason] FROM ox_failed
UNION ALL SELECT app_id, 'EXECUTOR_REMOVED', 'INFO', eval_ms, 'executor_' || executor_id || ', host: ' || host || ', completedTasks: ' ||
  completed_tasks || ', failedTask: ' || failed_tasks || ', inputBytes: ' || {fmt_bytes('input_bytes')} || ', shuffleReadBytes: ' ||
  {fmt_bytes('shuffle_read_bytes')} || ', average heap memory: ' || {fmt_bytes('avg_heap')} || ', max heap memory: ' || {fmt_bytes('max_heap')},
  '{{"appId":"' || app_id || '","executorId":"' || executor_id || '","host":"' || host || '","elapseTime":' || elapsed_ms ||
  ',"completedTasks":' || completed_tasks || ',"failedTask":' || failed_tasks || ',"inputBytes":' || input_bytes ||
  ',"shuffleReadBytes":' || shuffle_read_bytes || ',"averageHeapMemory":' || avg_heap || ',"maxHeapMemory":' || max_heap || '}}',
  app_id || '_EXECUTOR_REMOVED_executor' || executor_id, ['host ' || host, 'elapseTime ' || elapsed_ms, 'completedTasks ' || completed_tasks,
   'failedTask ' || failed_tasks, 'inputBytes ' || input_bytes, 'shuffleReadBytes ' || shuffle_read_bytes,
   'averageHeapMemory ' || avg_heap, 'maxHeapMemory ' || max_heap] FROM ox_rollup
UNION ALL SELECT app_id, event, level, eval_ms, message, NULL, NULL, [] FROM ox_all WHERE event <> 'TASK_FAILED'""",
    "ox_console": f"SELECT app_id, event, {clock('eval_ms')} || ' ' || level || ': ' || text AS line FROM ox_records",
    "ox_json": """
SELECT app_id, event, '{"channel":"CHANNEL@SPARK@' || event || '","event":' || coalesce(body, 'null') || '}' AS line FROM ox_records""",
    "ox_throttled": """
SELECT *, row_number() OVER (PARTITION BY app_id, grp, CASE WHEN grp = 'heap' THEN executor_id END ORDER BY eval_ms, stage_id, rule_ord) AS firing
FROM (SELECT *, CASE rule WHEN 'long_tail' THEN 'long_tail' WHEN 'gc_overhead' THEN 'gc' WHEN 'heap_pressure' THEN 'heap' ELSE 'skew' END AS grp
  FROM (SELECT * FROM ox_task_alerts UNION ALL SELECT * FROM ox_heap_alerts))""",
}

# Metrics of attempts that the log gives at their end.
END_METRICS = [
    "getting_result_ms", "run_ms", "deserialize_ms", "result_ser_ms", "gc_ms", "input_bytes", "input_records", "output_bytes",
    "shuffle_local_bytes", "shuffle_remote_bytes", "shuffle_read_records", "shuffle_write_bytes", "shuffle_write_records",
]
ALERT = "app_id, event, level, rule, stage_id, stage_attempt_id, task_id, executor_id, eval_ms, rule_ord, message"
TASK_KEY = "app_id, stage_id, task_id"

SQL = {
    # Sources.
    "src_event_log": """
SELECT app_id, stage_id, stage_attempt_id, task_id, executor_id, host, status, launch_ms, finish_ms, duration_ms, failure_reason,
  """ + ", ".join(f"CASE WHEN running THEN 0 ELSE {c} END AS {c}" for c in END_METRICS) + " FROM ox_m",
    "src_event_log_applications": f"""
SELECT app_id, app_name, user_name AS "user", 'default' AS queue, start_ms AS submit_ms, start_ms, {E} AS end_ms FROM fx_apps""",
    "src_event_log_conf": """
SELECT app_id, key, value FROM fx_conf UNION ALL SELECT DISTINCT app_id, 'spark.yarn.queue', 'default' FROM fx_conf""",
    "src_event_log_executors": "SELECT app_id, executor_id, host, cores, added_ms, removed_ms FROM fx_executors",
    "src_event_log_stages": """
SELECT s.app_id, s.stage_id, s.stage_attempt_id, s.name, s.num_tasks, p.parent_ids, s.submission_ms, s.completion_ms,
  CASE WHEN s.completion_ms IS NOT NULL THEN s.failure_reason END AS failure_reason
FROM fx_stages s LEFT JOIN (SELECT app_id, stage_id, string_agg(parent_id, ',' ORDER BY parent_id) AS parent_ids FROM fx_stage_parents GROUP BY ALL) p
USING (app_id, stage_id)""",
    "src_event_log_rdds": """
SELECT 'app_' || (r.stage_id % 4) AS app_id, r.stage_id, 0 AS stage_attempt_id, r.rdd_id, p.parent_ids, r.callsite
FROM fx_rdds r LEFT JOIN (SELECT stage_id, rdd_id, string_agg(parent_id, ',' ORDER BY parent_id) AS parent_ids FROM fx_rdd_parents GROUP BY ALL) p
USING (stage_id, rdd_id)""",
    "src_task_list": "SELECT app_id, stage_id, stage_attempt_id, task_id, status, time_ms FROM ox_m",
    "src_executor_inventory": "SELECT app_id, executor_id, host FROM fx_executors WHERE executor_id <> 'driver'",
    "src_executor_samples": "SELECT app_id, executor_id, ts_ms, heap_used FROM fx_samples",
    "src_host_samples": """
SELECT metric, instance, mode, cpu, ts_ms, round(value, 6) AS value FROM fx_host_samples WHERE ts_ms // 1000 % 10 <> 9""",
    "src_app_conf": "SELECT * FROM ox_config",
    # Sinks.
    "sink_console_lines": "SELECT app_id, event, line FROM ox_console",
    "sink_event_json": "SELECT app_id, event, line FROM ox_json",
    "sink_graphite_lines": f"""
SELECT app_id, event, prefix || '_' || point || ' {E // 1000}' AS line
FROM (SELECT app_id, event, prefix, unnest(points) AS point FROM ox_records WHERE prefix IS NOT NULL)""",
    "sink_executor_samples": "SELECT app_id, executor_id, ts_ms, heap_used FROM fx_samples",
    "sink_route": """
SELECT 'log' AS sink, app_id, event, line FROM ox_console
UNION ALL SELECT 'metaserver', app_id, event, line FROM ox_json
WHERE event IN ('APP_START', 'APP_END', 'STAGE_COMPLETED', 'TASK_FAILED', 'EXECUTOR_REMOVED')""",
    # Projections, filters, predicates.
    "task_effective_time": f"SELECT {TASK_KEY}, time_ms FROM ox_m",
    "task_input_eligible": f"SELECT {TASK_KEY}, eligible FROM ox_t",
    "stage_bytes_nonfailed": """
SELECT app_id, stage_id, stage_attempt_id, input_bytes, output_bytes, shuffle_read_bytes, shuffle_write_bytes FROM ox_stats""",
    "gate_running_only": "\nUNION ALL ".join(
        f"SELECT app_id, stage_id, rule, task_id, message FROM ({rule(r, True, 'ox_plain')})" for r in FIRES
    ),
    "gate_half_finished": f"""
SELECT s.app_id, s.stage_id, s.num_tasks, f.n AS n_finished FROM fx_stages s
JOIN (SELECT app_id, stage_id, count(*) FILTER (WHERE finish_ms <= {HALF_MS}) AS n FROM fx_tasks GROUP BY ALL) f USING (app_id, stage_id)
WHERE s.completion_ms IS NULL AND s.submission_ms IS NOT NULL AND f.n * 1e0 / s.num_tasks >= 0.5e0""",
    "task_snapshot_at": f"""
SELECT {TASK_KEY}, CASE WHEN finish_ms <= {HALF_MS} THEN status ELSE 'RUNNING' END AS status,
  CASE WHEN finish_ms <= {HALF_MS} THEN finish_ms END AS finish_ms, CASE WHEN finish_ms <= {HALF_MS} THEN duration_ms END AS duration_ms,
  CASE WHEN finish_ms <= {HALF_MS} THEN failure_reason END AS failure_reason
FROM fx_tasks WHERE launch_ms <= {HALF_MS}""",
    "gc_candidate": f"SELECT {TASK_KEY}, gc_ms, time_ms FROM ox_m WHERE {GC_COND}",
    "failed_attempts": f"SELECT {TASK_KEY}, status, failure_reason FROM ox_failed",
    # Joins.
    "stage_parent_shuffle": "SELECT app_id, stage_id, num_tasks, CAST(parent_shuffle_bytes AS BIGINT) AS parent_shuffle_bytes FROM ox_parents",
    "failure_stage_context": "SELECT * FROM ox_context",
    "executor_heap_join": "SELECT app_id, executor_id, host, avg_heap, max_heap FROM ox_rollup",
    "host_instance_resolve": "SELECT h.host, n.instance FROM ox_hosts h LEFT JOIN ox_names n USING (host)",
    "straggler_host_asof": 'SELECT app_id, stage_id, task_id, host, eval_ms, load1, load5, load15, system, idle, "user" FROM ox_state_asof',
    "skew_with_callsite": """
SELECT app_id, stage_id, rule, task_id, message FROM ox_task_alerts WHERE rule IN ('shuffle_read_skew', 'shuffle_write_skew')""",
    # Aggregations.
    "stage_task_distribution": f"SELECT {STATS_COLUMNS} FROM ox_stats",
    "stage_argmax_tasks": """
SELECT app_id, stage_id, stage_attempt_id, time_host, gc_max, gc_time, time_task_id, time_running, input_task_id, input_running,
  read_task_id, read_running, write_task_id, write_running, gc_task_id, gc_running FROM ox_stats""",
    "stage_five_numbers": "SELECT app_id, stage_id, stage_attempt_id, " + ", ".join(
        f"{_five(m, i, q)} AS {m}_{n}" for m in ("run", "delay") for i, (n, q) in enumerate(QS)
    ) + " FROM ox_stats WHERE len(run_list) > 0",
    "stage_running_bytes": "SELECT app_id, stage_id, stage_attempt_id, input_bytes, shuffle_read_bytes FROM ox_stats",
    "executor_heap_stats": "SELECT app_id, executor_id, min_heap, max_heap, total_heap, samples, avg_heap FROM ox_heap",
    "executor_rollup": "SELECT * FROM ox_rollup",
    "stage_summary": "SELECT * FROM ox_stage_done",
    "app_summary": """
SELECT app_id, user_name AS "user", queue, submit_ms, start_ms, end_ms, elapsed_ms, driver_memory, executor_memory, executor_cores,
  shuffle_partitions, max_dynamic_executors, executor_instances, memory_seconds, vcore_seconds FROM ox_app""",
    "stage_finished_count": "SELECT app_id, stage_id, stage_attempt_id, n_finished FROM ox_stats",
    # Rules.
    **{
        f"diag_{name}": rule(name, source="ox_plain")
        for name in ("long_tail", "input_skew", "gc_overhead")
    },
    **{f"diag_{name}": rule(name) for name in ("shuffle_read_skew", "shuffle_write_skew")},
    "diag_scheduler_delay": f"SELECT {ALERT} FROM ox_delay",
    "diag_shuffle_read_notice": f"SELECT {ALERT} FROM ox_notice",
    "diag_heap_pressure": f"SELECT {ALERT} FROM ox_heap_alerts",
    "diag_unexplained_straggler": f"SELECT {ALERT} FROM ox_straggler_alerts",
    "diag_executor_lost": f"SELECT {ALERT} FROM ox_lost",
    "diag_task_failure": f"SELECT {ALERT} FROM ox_events UNION ALL SELECT {ALERT} FROM ox_causes",
    "diag_oom_report": f"SELECT {ALERT} FROM ox_oom",
    "diag_all": f"SELECT {ALERT} FROM ox_all",
    # Windows.
    "alert_throttle": f"SELECT {ALERT} FROM ox_throttled WHERE (firing - 1) % 3 = 0",
    "alert_throttle_host": f"""
SELECT {ALERT} FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY eval_ms, stage_id, stage_attempt_id) AS firing FROM ox_straggler_alerts)
WHERE (firing - 1) % 2 = 0""",
    "executor_latest_sample": "SELECT app_id, executor_id, max(ts_ms) AS ts_ms, max_by(heap_used, ts_ms) AS heap_used FROM fx_samples GROUP BY app_id, executor_id",
    "executor_poll_failures": """
SELECT app_id, executor_id, ts_ms, ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY app_id, executor_id ORDER BY ts_ms
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS failed_polls FROM fx_polls""",
    "host_counter_rate": """
WITH steps AS (SELECT metric, instance, mode, cpu, ts_ms, value, lag(ts_ms) OVER w AS before_ms, lag(value) OVER w AS before_value
  FROM fx_host_samples WHERE metric IN ('node_cpu', 'node_vmstat_pgpgin', 'node_vmstat_pgpgout')
  WINDOW w AS (PARTITION BY metric, instance, mode, cpu ORDER BY ts_ms)),
grown AS (SELECT *, CASE WHEN value >= before_value THEN value - before_value ELSE value END AS step FROM steps),
sums AS (SELECT *, coalesce(sum(CASE WHEN before_ms IS NOT NULL THEN step END) OVER r, 0) AS total, min(ts_ms) OVER r AS first_ms, count(*) OVER r AS n,
    coalesce(first_value(CASE WHEN before_ms IS NOT NULL THEN step END) OVER r, 0) AS first_step
  FROM grown WINDOW r AS (PARTITION BY metric, instance, mode, cpu ORDER BY ts_ms RANGE BETWEEN 4999 PRECEDING AND CURRENT ROW))
SELECT metric, instance, mode, cpu, ts_ms, round(CASE WHEN n >= 2 THEN (total - first_step) / ((ts_ms - first_ms) / 1000e0)
  WHEN ts_ms - before_ms < 300000 THEN step / ((ts_ms - before_ms) / 1000e0) END, 6) AS rate FROM sums""",
    # Hosts.
    "host_load": """
SELECT host, eval_ms, max(value) FILTER (WHERE metric = 'node_load1') AS load1, max(value) FILTER (WHERE metric = 'node_load5') AS load5,
  max(value) FILTER (WHERE metric = 'node_load15') AS load15
FROM ox_latest WHERE metric LIKE 'node_load%' GROUP BY host, eval_ms""",
    "host_cpu_usage": f"""
SELECT n.host, s.eval_ms, s.mode, {CPU_USAGE} AS usage FROM ox_cpu_series s JOIN ox_names n USING (instance)
GROUP BY n.host, s.eval_ms, s.mode HAVING {CPU_USAGE} IS NOT NULL""",
    "host_memory_available": """
SELECT host, eval_ms, CAST(floor(coalesce(max(value) FILTER (WHERE metric = 'node_memory_MemAvailable'),
  max(value) FILTER (WHERE metric = 'node_memory_MemFree') + max(value) FILTER (WHERE metric = 'node_memory_Buffers')
  + max(value) FILTER (WHERE metric = 'node_memory_Cached'), 0)) AS BIGINT) AS available_bytes
FROM ox_latest WHERE metric LIKE 'node_memory%' GROUP BY host, eval_ms""",
    "host_io_rate": """
SELECT n.host, s.eval_ms, round(coalesce(max(coalesce(rate, irate) * 1024) FILTER (WHERE metric = 'node_vmstat_pgpgin'), 0), 6) AS page_in,
  round(coalesce(max(coalesce(rate, irate) * 1024) FILTER (WHERE metric = 'node_vmstat_pgpgout'), 0), 6) AS page_out
FROM ox_io_series s JOIN ox_names n USING (instance) GROUP BY n.host, s.eval_ms""",
    # Graph, top-k.
    "stage_rdd_callsite": "SELECT app_id, stage_id, rdd_id, callsite FROM ox_sites",
    "top_tasks_per_stage": """
SELECT app_id, stage_id, task_id, time_ms, position FROM (SELECT *, row_number() OVER (PARTITION BY app_id, stage_id, stage_attempt_id
  ORDER BY time_ms DESC, task_id) AS position FROM ox_m) WHERE position <= 5""",
    # Scalar functions.
    "fmt_bytes": "WITH b AS (SELECT CAST(floor(l_extendedprice * 1000) AS BIGINT) AS n FROM lineitem) SELECT n, "
    + ", ".join(
        f"{fmt_bytes(x)} AS {name}"
        for name, x in (("small", "(n % 1500)"), ("kilo", "(n // 100)"), ("plain", "n"), ("giga", "(n * 997)"), ("tera", "(n * 999983)"))
    ) + " FROM b",
    "fmt_duration": f"SELECT task_id, {fmt_duration('time_ms')} AS text, {fmt_duration('(time_ms * 997)')} AS long_text FROM fx_metrics",
    "failure_class": f"""
SELECT {TASK_KEY}, CASE WHEN {OOM} THEN 'OOM' WHEN failure_reason LIKE '%spark.shuffle.FetchFailedException%' AND
  failure_reason LIKE '%Failed to connect to%' THEN 'Shuffle Fetcher ERROR' WHEN failure_reason LIKE '%ExecutorLostFailure%'
  THEN 'ExecutorLostFailure' END AS class FROM ox_failed""",
    "failure_advice": f"SELECT {TASK_KEY}, {advice('failure_reason')} AS advice FROM ox_failed",
    "parse_size": """
WITH s AS (SELECT o_orderkey, o_orderkey % 4096 AS n, ['', 'b', 'k', 'kb', 'm', 'mb', 'g', 'gb', 't', 'tb', 'p', 'pb', 'x'][o_orderkey % 13 + 1] AS u FROM orders)
SELECT o_orderkey, n || u AS text, CASE u WHEN '' THEN n WHEN 'b' THEN n WHEN 'x' THEN NULL
  ELSE n * CASE substr(u, 1, 1) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN 't' THEN 1099511627776
  ELSE 1125899906842624 END END AS bytes FROM s""",
    "app_config": "SELECT * FROM ox_settings",
    "failure_text": f"SELECT {TASK_KEY}, failure_reason AS text FROM fx_tasks WHERE status <> 'RUNNING'",
    "executor_id_from_path": """
SELECT app_id, ts_ms, executor_id AS from_sample, CAST(NULL AS VARCHAR) AS from_other FROM fx_samples""",
    # Streams: the state after all rows equals the batch result.
    "stream_stage_progress": "SELECT app_id, stage_id, stage_attempt_id, n_finished FROM ox_stats WHERE n_finished > 0",
    "stream_heap_monitor": """
SELECT h.*, coalesce(a.n, 0) AS alerts FROM ox_heap h LEFT JOIN (SELECT app_id, executor_id, count(*) AS n FROM ox_heap_alerts
GROUP BY app_id, executor_id) a USING (app_id, executor_id)""",
    "stream_alert_throttle": f"""
SELECT {ALERT} FROM ox_throttled WHERE rule = 'heap_pressure' AND (firing - 1) % 3 = 0""",
    "stream_executor_lost": "SELECT app_id, executor_id, ts_ms FROM ox_nth_poll WHERE nth = 3",
    "stream_stage_completed": "SELECT * FROM ox_stage_done",
    "stream_completion_alerts": "\nUNION ALL ".join(
        f"SELECT {ALERT} FROM {v} SEMI JOIN (SELECT app_id, stage_id, stage_attempt_id FROM fx_stages WHERE completion_ms IS NOT NULL) "
        "USING (app_id, stage_id, stage_attempt_id)"
        for v in ("ox_task_alerts", "ox_straggler_alerts", "ox_delay")
    ),
    # A stream counts an attempt when it has ended.
    "stream_executor_rollup": """
SELECT r.* REPLACE (coalesce(t.input_bytes, 0) AS input_bytes, coalesce(t.read_bytes, 0) AS shuffle_read_bytes) FROM ox_rollup r
LEFT JOIN (SELECT app_id, executor_id, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(shuffle_local_bytes + shuffle_remote_bytes) AS BIGINT) AS read_bytes
  FROM fx_tasks WHERE status <> 'RUNNING' GROUP BY ALL) t USING (app_id, executor_id)""",
    "stream_shuffle_notice": f"""
SELECT app_id, 'STAGE_DIAGNOSIS' AS event, 'INFO' AS level, 'shuffle_read_notice' AS rule, stage_id, stage_attempt_id,
  CAST(NULL AS BIGINT) AS task_id, CAST(NULL AS VARCHAR) AS executor_id, submission_ms AS eval_ms, 0 AS rule_ord,
  'stage ' || stage_id || ' (' || name || ') prepare to shuffle read ' || {fmt_bytes('parent_bytes')} || ', total tasks: ' || num_tasks AS message
FROM (SELECT s.app_id, s.stage_id, s.stage_attempt_id, s.name, s.num_tasks, s.submission_ms, CAST(sum(w.bytes) AS BIGINT) AS parent_bytes
  FROM fx_stages s JOIN fx_stage_parents p ON p.app_id = s.app_id AND p.stage_id = s.stage_id
  JOIN (SELECT app_id, stage_id, sum(CASE WHEN status NOT IN ('FAILED', 'RUNNING') THEN shuffle_write_bytes ELSE 0 END) AS bytes
    FROM fx_tasks GROUP BY ALL) w ON w.app_id = p.app_id AND w.stage_id = p.parent_id
  WHERE s.submission_ms IS NOT NULL GROUP BY ALL HAVING sum(w.bytes) > 0)""",
    "stream_state_expiry": """
SELECT app_id, executor_id, count(*) AS fired, max(eval_ms) AS last_ms FROM ox_heap_alerts GROUP BY app_id, executor_id
HAVING max(eval_ms) > (SELECT max(eval_ms) FROM ox_heap_alerts) - 60000""",
    "stream_task_failures": f"SELECT {ALERT} FROM ox_events UNION ALL SELECT {ALERT} FROM ox_causes",
    "stream_inflight_monitor": "\nUNION ALL ".join(
        f"SELECT app_id, stage_id, rule, task_id, message FROM ({rule(r, True, 'ox_plain')}) "
        "WHERE (app_id, stage_id) IN (SELECT s.app_id, s.stage_id FROM fx_stages s JOIN ox_stats t "
        "USING (app_id, stage_id, stage_attempt_id) WHERE s.completion_ms IS NULL AND t.n_finished * 1e0 / s.num_tasks >= 0.5e0)"
        for r in FIRES
    ),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        text = with_views(sql, VIEWS)
        out[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if "ox_walk" in text else text
    return out
