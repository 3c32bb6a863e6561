"""Per-stage aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import time_sql
from ..schemas import STAGE_KEYS
from ..settings import HOT_ROWS, Thresholds
from .skew import exact_ranks, split_hot
from .tasks import DELAY, GC_CANDIDATE, INPUT_ELIGIBLE, READ_BYTES, effective_time, metric

# Quantiles of the five-number summary, and the percentiles of each distribution.
FIVE_QUANTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
PERCENTILES = {"time": [0.5], "input": [0.75], "read": [0.5, 0.75], "write": [0.5, 0.75]}
FIVE_METRICS = ["run", "delay"]
SPREAD = ["time", "input", "read", "write"]
# Task id where no task has a value above 0.
NO_TASK = -1


def _measures(tasks: DataFrame, eval_ms: int | str, th: Thresholds) -> DataFrame:
    """The columns the aggregates need, with the per-metric row conditions folded in as nulls."""
    timed = tasks.withColumn("time", F.expr(effective_time(eval_ms)))
    eligible = INPUT_ELIGIBLE.format(time="time", old=th.old_task_ms)
    candidate = GC_CANDIDATE.format(time="time", old=th.old_task_ms, floor=th.gc_floor_ms)
    ok, kept = "status = 'SUCCESS'", "status <> 'FAILED'"
    return timed.selectExpr(
        *STAGE_KEYS, "task_id", "host", "status = 'RUNNING' AS running", "time",
        f"if({eligible}, {metric('input_records')}, NULL) AS input",
        f"{metric('shuffle_read_records')} AS read",
        f"{metric('shuffle_write_records')} AS write",
        f"if({candidate}, {metric('gc_ms')}, NULL) AS gc",
        f"if({ok}, {metric('run_ms')}, NULL) AS run",
        f"if({ok}, {DELAY}, NULL) AS delay",
        f"if({kept}, {metric('input_bytes')}, NULL) AS in_bytes",
        f"if({kept}, {READ_BYTES}, NULL) AS read_bytes",
        f"if({kept}, {metric('shuffle_write_bytes')}, NULL) AS write_bytes",
        f"if({kept}, {metric('output_bytes')}, NULL) AS out_bytes",
    )


def _argmax(m: str) -> str:
    """Row of the largest value above 0; ties go to the longest task, then to the lowest id."""
    row = f"struct({m} AS value, time, -task_id AS neg_id, host, running)"
    return f"max(if({m} > 0, {row}, NULL)) AS {m}_top"


# Aggregates with buffers of fixed size, for stages of any size.
BOUNDED = [
    "count(*) AS n_tasks",
    "count_if(NOT running) AS n_finished",
    *[f"{f}({m}) AS {m}_{f}" for m in SPREAD for f in ("min", "max")],
    "sum(input) AS input_sum",
    "count(input) AS input_n",
    *[_argmax(m) for m in [*SPREAD, "gc"]],
    *[f"coalesce(sum({m}), 0) AS {m}_sum" for m in ("in_bytes", "read_bytes", "write_bytes", "out_bytes")],
]


def _position(p: float, n: str) -> str:
    """Where percentile ``p`` lies among ``n`` sorted values; between two it is interpolated."""
    return f"({p}D * ({n} - 1))"


def _five_rank(q: float, n: str) -> str:
    return f"least(floor({q}D * {n}), {n} - 1)"


def _interpolated(low: str, high: str, share: str) -> str:
    return f"{low} * (1 - {share}) + {high} * {share}"


def _ordinary(measures: DataFrame) -> DataFrame:
    """Everything in one aggregation, for stages whose values fit a task.

    Sorted lists give all order statistics and are cheaper than hash-based percentiles.  A rank in an
    empty list is null.  Picking the values inside the aggregation keeps the conditions of the rules,
    which Spark moves down to it, short.
    """
    def values(m: str) -> str:
        return f"sort_array(collect_list({m}))"

    def at(m: str, rank: str) -> str:
        return f"get({values(m)}, int({rank}))"

    def percentile(m: str, p: float) -> str:
        where = _position(p, f"size({values(m)})")
        return _interpolated(at(m, f"floor({where})"), at(m, f"ceil({where})"), f"({where} - floor({where}))")

    def array(m: str, picked: list[str], name: str) -> str:
        return f"array({', '.join(picked)}) AS {m}_{name}"

    return measures.groupBy(*STAGE_KEYS).agg(*map(F.expr, [
        *BOUNDED,
        *[array(m, [percentile(m, p) for p in ps], "pct") for m, ps in PERCENTILES.items()],
        *[array(m, [at(m, _five_rank(q, f"size({values(m)})")) for q in FIVE_QUANTILES], "five") for m in FIVE_METRICS],
    ]))


def _approximate(measures: DataFrame, accuracy: int) -> DataFrame:
    """One aggregation with sketches of fixed size: order statistics within 1/accuracy of their rank."""
    def sketch(m: str, ps: list[float], name: str) -> str:
        return f"percentile_approx({m}, array({', '.join(f'{p}D' for p in ps)}), {accuracy}) AS {m}_{name}"

    return measures.groupBy(*STAGE_KEYS).agg(*map(F.expr, [
        *BOUNDED,
        *[sketch(m, ps, "pct") for m, ps in PERCENTILES.items()],
        *[sketch(m, FIVE_QUANTILES, "five") for m in FIVE_METRICS],
    ]))


def _hot(measures: DataFrame) -> DataFrame:
    """The same columns for hot stages: fixed-size aggregates, and order statistics by exact ranks."""
    base = measures.groupBy(*STAGE_KEYS).agg(*map(F.expr, BOUNDED))
    position = {p: _position(p, "n") for p in (0.5, 0.75)}
    five = {q: f"bigint({_five_rank(q, 'n')})" for q in FIVE_QUANTILES}
    ranks = [f"bigint({f}({at}))" for at in position.values() for f in ("floor", "ceil")] + list(five.values())
    found = exact_ranks(measures, STAGE_KEYS, [*SPREAD, *FIVE_METRICS], f"array({', '.join(ranks)})")

    def value_at(m: str, rank: str) -> str:
        return f"max(if(metric = '{m}' AND rank = {rank}, value, NULL))"

    def percentile(m: str, p: float) -> str:
        at = position[p]
        share = f"max(if(metric = '{m}', {at} - floor({at}), NULL))"
        return _interpolated(value_at(m, f"floor({at})"), value_at(m, f"ceil({at})"), share)

    percentiles = [f"array({', '.join(percentile(m, p) for p in ps)}) AS {m}_pct" for m, ps in PERCENTILES.items()]
    fives = [f"array({', '.join(value_at(m, r) for r in five.values())}) AS {m}_five" for m in FIVE_METRICS]
    picked = found.groupBy(*STAGE_KEYS).agg(*map(F.expr, [*percentiles, *fives]))
    return base.join(picked, STAGE_KEYS, "left")


def _plain_columns() -> list[str]:
    """The published columns that need no order statistic; an empty distribution counts as 0."""
    columns = ["n_tasks", "n_finished"]
    for m in SPREAD:
        columns += [f"coalesce({m}_{f}, 0L) AS {m}_{f}" for f in ("min", "max")]
        columns += [f"coalesce(-{m}_top.neg_id, {NO_TASK}L) AS {m}_task_id",
                    f"coalesce({m}_top.running, false) AS {m}_running"]
    columns += [
        "coalesce(input_sum div nullif(input_n, 0), 0L) AS input_mid",
        f"coalesce(-gc_top.neg_id, {NO_TASK}L) AS gc_task_id", "coalesce(gc_top.running, false) AS gc_running",
        "coalesce(gc_top.value, 0L) AS gc_max", "coalesce(gc_top.time, 0L) AS gc_time",
        "coalesce(time_top.host, '') AS time_host",
        "in_bytes_sum AS input_bytes", "read_bytes_sum AS shuffle_read_bytes",
        "write_bytes_sum AS shuffle_write_bytes", "out_bytes_sum AS output_bytes",
    ]
    return columns


def _statistics() -> list[str]:
    """All published columns."""
    def whole(sql: str, name: str) -> str:
        return f"coalesce(bigint(floor({sql})), 0L) AS {name}"

    return [
        *_plain_columns(),
        whole("time_pct[0]", "time_mid"), whole("input_pct[0]", "input_p75"),
        whole("read_pct[0]", "read_mid"), whole("read_pct[1]", "read_p75"),
        whole("write_pct[0]", "write_mid"), whole("write_pct[1]", "write_p75"),
        "run_five", "delay_five",
    ]


def plain_stats(tasks: DataFrame, eval_ms: int | str, th: Thresholds = Thresholds()) -> DataFrame:
    """The statistics of :func:`stage_stats` without medians, quartiles and five-number summaries.

    One aggregation with buffers of fixed size, combined before its only shuffle, for stages of any size; no job runs
    while the query is built.  Largest tasks, bytes and the GC and running-byte rules need no more.
    """
    stats = _measures(tasks, eval_ms, th).groupBy(*STAGE_KEYS).agg(*map(F.expr, BOUNDED))
    return stats.selectExpr(*STAGE_KEYS, *_plain_columns())


def stage_stats(
    tasks: DataFrame,
    eval_ms: int | str,
    th: Thresholds = Thresholds(),
    hot_rows: int | None = HOT_ROWS,
    accuracy: int | None = None,
) -> DataFrame:
    """All per-stage statistics the rules use: one row per stage attempt, one pass over the tasks.

    Time, shuffle-read and shuffle-write distributions cover every attempt, input only eligible ones.
    The centre is the median, except for input, where it is the mean.  Columns a caller does not
    use are pruned together with their aggregates.  Hot stages get their percentiles another way, see
    :mod:`skew`; the look-up for them counts the attempts per stage at once.  Where no percentile is
    needed, :func:`plain_stats` does without it.

    With ``accuracy`` the order statistics are approximate (maxima and largest tasks stay exact) and
    stages of any size take the same single pass.
    """
    measures = _measures(tasks, eval_ms, th)
    if accuracy is not None:
        return _approximate(measures, accuracy).selectExpr(*STAGE_KEYS, *_statistics())
    ordinary, hot = split_hot(measures, STAGE_KEYS, hot_rows)
    stats = _ordinary(ordinary)
    if hot is not None:
        stats = stats.unionByName(_hot(hot))
    return stats.selectExpr(*STAGE_KEYS, *_statistics())


def task_distribution(stats: DataFrame) -> DataFrame:
    """Minimum, centre, upper quartile and maximum of each metric."""
    return stats.select(
        *STAGE_KEYS, "n_tasks", "time_min", "time_mid", "time_max",
        *[f"{m}_{part}" for m in ("input", "read", "write") for part in ("min", "mid", "p75", "max")],
    )


def argmax_tasks(stats: DataFrame) -> DataFrame:
    """Task holding the maximum of each metric; -1 where nothing is above 0."""
    return stats.select(
        *STAGE_KEYS, "time_host", "gc_max", "gc_time",
        *[f"{m}_{part}" for m in ("time", "input", "read", "write", "gc") for part in ("task_id", "running")],
    )


def five_numbers(stats: DataFrame) -> DataFrame:
    """Quantiles 0, ¼, ½, ¾, 1 of run time and scheduler delay over successful attempts."""
    names = ["min", "q1", "median", "q3", "max"]
    return stats.filter("run_five[0] IS NOT NULL").selectExpr(
        *STAGE_KEYS, *[f"{m}_five[{i}] AS {m}_{name}" for m in FIVE_METRICS for i, name in enumerate(names)]
    )


def running_bytes(stats: DataFrame) -> DataFrame:
    """Bytes read from input and shuffle by attempts that did not fail."""
    return stats.select(*STAGE_KEYS, "input_bytes", "shuffle_read_bytes")


def stage_bytes(tasks: DataFrame) -> DataFrame:
    """Bytes moved by attempts that did not fail, straight from the tasks."""
    sums = {
        "input_bytes": metric("input_bytes"), "output_bytes": metric("output_bytes"),
        "shuffle_read_bytes": READ_BYTES, "shuffle_write_bytes": metric("shuffle_write_bytes"),
    }
    # Failed attempts give 0 instead of being filtered out, so a stage of failures keeps its row.
    return tasks.groupBy(*STAGE_KEYS).agg(
        *[F.expr(f"sum(if(status <> 'FAILED', {sql}, 0L)) AS {name}") for name, sql in sums.items()]
    )


def finished_counts(tasks: DataFrame) -> DataFrame:
    """Ended attempts per stage, failures included."""
    return tasks.groupBy(*STAGE_KEYS).agg(F.expr("count_if(status <> 'RUNNING') AS n_finished"))


def stages_at(stages: DataFrame, at_ms: int | str) -> DataFrame:
    """The stages as they stood at ``at_ms``: submitted by then, open if they completed later."""
    at = time_sql(at_ms)
    later = [
        f"if(completion_ms <= {at}, {c}, NULL) AS {c}" if c in ("completion_ms", "failure_reason") else c
        for c in stages.columns
    ]
    return stages.filter(f"submission_ms <= {at}").selectExpr(*later)


def half_finished(stages: DataFrame, finished: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Open stages (submitted, not completed) with enough ended attempts to judge them.

    ``finished`` has ``n_finished`` per stage; its other columns are kept, so whole statistics will do.
    """
    return (
        stages.filter("submission_ms IS NOT NULL AND completion_ms IS NULL")
        .join(finished, STAGE_KEYS)
        .filter(f"n_finished >= {th.finished_ratio}D * num_tasks")
    )


def stage_summary(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Facts of completed stages without a failure reason."""
    done = stages.filter("completion_ms IS NOT NULL AND failure_reason IS NULL")
    moved = ["input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes"]
    return done.join(stage_bytes(tasks), STAGE_KEYS, "left").selectExpr(
        *STAGE_KEYS, "completion_ms - coalesce(submission_ms, 0L) AS elapsed_ms", "num_tasks",
        *[f"coalesce({c}, 0L) AS {c}" for c in moved], "completion_ms AS eval_ms",
    )


def parent_shuffle(stages: DataFrame, written: DataFrame) -> DataFrame:
    """Shuffle bytes written by the parents of each stage; only stages where that is above 0.

    ``written`` has ``(app_id, stage_id, stage_attempt_id, shuffle_write_bytes)``; of a retried
    parent the last attempt counts, an unknown parent counts as 0.  Parents are stages of the same
    application.
    """
    last = "max(struct(stage_attempt_id, shuffle_write_bytes)).shuffle_write_bytes AS parent_bytes"
    per_stage = written.groupBy("app_id", F.col("stage_id").alias("parent_id")).agg(F.expr(last))
    stage = [*STAGE_KEYS, "name", "num_tasks", "submission_ms"]
    links = stages.selectExpr(*stage, "explode(parent_ids) AS parent_id")
    return (
        links.join(per_stage, ["app_id", "parent_id"])
        .groupBy(*stage)
        .agg(F.sum("parent_bytes").alias("parent_shuffle_bytes"))
        .filter("parent_shuffle_bytes > 0")
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
