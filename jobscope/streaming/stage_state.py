"""Live stage evaluation from keyed state: a trigger touches only stages with news.

State is kept per stage attempt: the rows told of its task attempts, in chunks, and the facts of the stage.  Rows come in
any order.  The state decides *which* stages are due and hands out what it knows of them; judging them is the work of the
batch operators, so a trigger gives what a batch over the same rows would.  Waiting goes by the clock of the telemetry: a
timer fires when the watermark, the newest time seen less the lateness, passes it.

Attempts reach the state and leave it in packs of Arrow rows, as Spark hands rows to a Python state one by one.  A worker
holds a few packs at a time, and of the stage it hands out some ten numbers per attempt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import hosts, rules, stages, tasks
from ..schemas import STAGE_KEYS, TASK_ATTEMPTS
from ..settings import Thresholds
from .state import append_batch, run, with_rocksdb

# Fixed value: how often open stages are judged again when nothing is heard of them.
RECHECK_MS = 3_000
# How long a stage that no one writes of is remembered.
KEEP_MS = 6 * 3_600_000
# How late a row may be; a completed stage waits that long for the attempts that are still missing.
LATENESS = "10 minutes"
# Chunks of a stage are merged when there are so many, those of fewer rows than this.
MOST_CHUNKS, CHUNK_ROWS = 16, 20_000
# So many rows of a partition are looked at when they are packed, and so far apart the ends of the attempts in a pack may be.
PACKED_ROWS, PACKED_MS = 200_000, 60_000
# The packs of due stages are opened by so many tasks for each core.
TASKS_PER_CORE = 4

OPEN, COMPLETED = "open", "completed"
FACTS = "name string, num_tasks bigint, submission_ms bigint, completion_ms bigint, stage_failure string"
ATTEMPT = ", ".join(part for part in TASK_ATTEMPTS.split(", ") if part.split()[0] not in STAGE_KEYS)
KEYS = "app_id string, stage_id int, stage_attempt_id int"
PACK = f"at_ms bigint, {KEYS}, rows binary"
DUE = f"phase string, {KEYS}, {FACTS}, rivals boolean, rows binary"
DUE_ATTEMPT = f"{KEYS}, rivals boolean, {ATTEMPT}"

_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


_ATTEMPT = _arrow(ATTEMPT)
_CHUNK = _ATTEMPT.append(pa.field("turn", pa.int64()))
# State hands its chunks to Python, and Spark its records, in portions of so many packs and bytes.
PACKS_AT_ONCE = {
    "spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch": "16",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}
_NULLABLE = {pa.int64(): pd.Int64Dtype()}.get
_DUE = [part.split()[0] for part in DUE.split(", ")]
_FACTS = [part.split()[0] for part in FACTS.split(", ")]


def stage_rows(stage_updates: DataFrame) -> DataFrame:
    """Rows of stages as records; a stage may be told of any number of times, later facts fill in or replace earlier."""
    known = {"stage_failure": "failure_reason"}
    return stage_updates.selectExpr(
        "timestamp_millis(coalesce(completion_ms, submission_ms)) AS at", *STAGE_KEYS, *[f"{known.get(c, c)} AS {c}" for c in _FACTS],
        "CAST(NULL AS binary) AS rows",
    )


def attempt_rows(updates: DataFrame) -> DataFrame:
    """Packs of task attempts as records, each of one stage, with the time of the newest.

    A running attempt has no time of its own, so it is never too late; an ended one is at most ``PACKED_MS`` older than
    its pack, and may be that much later than others.
    """
    columns = [part.split() for part in f"{KEYS}, {ATTEMPT}".split(", ")]
    told = updates.selectExpr(f"finish_ms div {PACKED_MS} AS ends", *[f"CAST({name} AS {kind}) AS {name}" for name, kind in columns])
    return told.mapInArrow(_packs, PACK).selectExpr(
        "timestamp_millis(at_ms) AS at", *STAGE_KEYS, *[f"CAST(NULL AS {part.split()[1]}) AS {part.split()[0]}" for part in FACTS.split(", ")], "rows",
    )


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= PACKED_ROWS:
            yield from _by_stage(held)
            held = []
    if sum(map(len, held)):
        yield from _by_stage(held)


def _by_stage(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    group = np.zeros(len(rows), "int64")
    for c in [*STAGE_KEYS, "ends"]:
        codes = rows[c].chunk(0).dictionary_encode(null_encoding="encode")
        # Numbered anew after each column, so that they stay below the number of rows.
        group = np.unique(group * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    rows, ends = rows.take(order), np.cumsum(np.bincount(group))
    for start, end in zip([0, *ends[:-1]], ends):
        for i in range(start, end, CHUNK_ROWS):
            part = rows.slice(i, min(end - i, CHUNK_ROWS))
            attempts = part.filter(pc.is_valid(part["task_id"])).select(_ATTEMPT.names)
            yield pa.RecordBatch.from_pylist([{
                "at_ms": pc.max(part["finish_ms"]).as_py(), **{k: part[k][0].as_py() for k in STAGE_KEYS}, "rows": _packed(_told(attempts, 0)),
            }], _arrow(PACK))


def _told(attempts: pa.Table, turn: int) -> pa.Table:
    """Attempts with the turn they were told in."""
    return attempts.select(_ATTEMPT.names).append_column("turn", pa.repeat(pa.scalar(turn, pa.int64()), len(attempts))).cast(_CHUNK)


def _table(rows: pd.DataFrame) -> pa.Table:
    return pa.Table.from_pandas(rows, schema=_CHUNK, preserve_index=False)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _CHUNK, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def _frame(chunks: Iterable[pa.Table]) -> pd.DataFrame:
    return pa.concat_tables(chunks).to_pandas(types_mapper=_NULLABLE)


def _ended(rows: pa.Table) -> np.ndarray:
    return rows.filter(pc.not_equal(rows["status"], "RUNNING"))["task_id"].unique().to_numpy()


def _latest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per attempt: an ended row beats a running one, of two alike the later counts."""
    ended = (rows["status"] != "RUNNING").astype("int64")
    return rows.assign(ended=ended).sort_values(["ended", "turn"], kind="stable").drop_duplicates("task_id", keep="last").drop(columns="ended")


def _standing(chunks: Iterable[pa.Table]) -> np.ndarray:
    """For each row of the chunks: 0 if another of the same attempt beats it, 1 if it beats all others, 2 if some are its equal."""
    ids, ranks = [np.empty(0, "int64")], [np.empty(0, "int64")]
    for rows in chunks:
        ended = pc.fill_null(pc.add(pc.cast(pc.not_equal(rows["status"], "RUNNING"), pa.int64()), 1), 0)
        ids.append(rows["task_id"].to_numpy())
        ranks.append((ended.to_numpy() << 60) + rows["turn"].to_numpy())
    ids, ranks = np.concatenate(ids), np.concatenate(ranks)
    order = np.lexsort((ranks, ids))
    ids, ranks = ids[order], ranks[order]
    last = np.append(ids[1:] != ids[:-1], True)[:len(ids)]
    attempt = np.cumsum(last) - last
    best = ranks == ranks[last][attempt]
    out = np.empty(len(ids), "int8")
    out[order] = np.where(best, np.minimum(np.bincount(attempt[best], minlength=1)[attempt], 2), 0) if len(ids) else 0
    return out


def _due_attempts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The attempts of due stages from their packs."""
    schema = _arrow(DUE_ATTEMPT)
    for batch in batches:
        for pack in batch.to_pylist():
            rows = _unpacked(pack["rows"])
            columns = [pa.repeat(pa.scalar(pack[f.name], f.type), len(rows)) if f.name in pack else rows[f.name] for f in schema]
            yield from pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()


class StageState(StatefulProcessor):
    """Hands out the attempts of the stages that are due."""

    def __init__(self, finished_ratio: float, recheck_ms: int, keep_ms: int):
        self.finished_ratio, self.recheck_ms, self.keep_ms = finished_ratio, recheck_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("attempts", "rows binary")
        self.facts = handle.getValueState("stage", f"{FACTS}, ended bigint, turn bigint, chunks bigint, heard_ms bigint, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage = self._stage()
        if stage["closed"]:
            return  # what comes after the last look changes nothing
        turn, new = stage["turn"] + 1, []
        for chunk in rows:
            told = chunk["rows"].isna()
            for row in chunk.loc[told, _FACTS].itertuples(index=False):
                stage |= {c: v if isinstance(v, str) else int(v) for c, v in zip(_FACTS, row) if not pd.isna(v)}
            for pack in chunk.loc[~told, "rows"]:
                attempts = _unpacked(pack)
                if len(attempts):
                    stage["turn"] = turn
                    stage["ended"] += len(_ended(attempts))
                    new.append(_told(attempts, turn))
                if sum(map(len, new)) >= CHUNK_ROWS:
                    self._keep(stage, new)
                    new = []
        if new:
            self._keep(stage, new)
        stage["heard_ms"] = max(stage["heard_ms"], timerValues.getCurrentWatermarkInMs())
        yield from self._judge(key, stage, timerValues.getCurrentWatermarkInMs())

    def _keep(self, stage: dict, new: list[pa.Table]) -> None:
        rows = pa.concat_tables(new)
        stage["chunks"] += len(rows) < CHUNK_ROWS
        self.chunks.appendValue((_packed(rows),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, stage = timerValues.getCurrentWatermarkInMs(), self._stage()
        waits = stage["completion_ms"] is not None and stage["num_tasks"] is not None
        if stage["closed"] or not waits and now - stage["heard_ms"] >= self.keep_ms:
            self.chunks.clear()
            self.facts.clear()
        else:
            yield from self._judge(key, stage, now)

    def close(self) -> None:
        pass

    def _stage(self) -> dict:
        names = [*_FACTS, "ended", "turn", "chunks", "heard_ms", "closed"]
        found = self.facts.get() if self.facts.exists() else (None,) * len(_FACTS) + (0, 0, 0, 0, False)
        return dict(zip(names, found))

    def _judge(self, key, stage: dict, now: int) -> Iterator[pd.DataFrame]:
        """Hands the attempts out if the stage is due, stores its facts, and sets the one timer it has."""
        enough = stage["num_tasks"] is not None and stage["submission_ms"] is not None
        wait_to = now + self.keep_ms
        if enough and stage["completion_ms"] is not None:
            if now >= stage["completion_ms"] or self._all_ended(stage):
                yield from self._due(COMPLETED, key, stage)
                self.chunks.clear()
                stage["closed"] = True
            else:
                wait_to = stage["completion_ms"]
        elif enough and stage["ended"] >= self.finished_ratio * stage["num_tasks"]:
            yield from self._due(OPEN, key, stage)
            wait_to = now + self.recheck_ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(wait_to, now + 1))
        self.facts.update(tuple(stage.values()))

    def _known(self, stage: dict) -> Iterator[pa.Table]:
        """The chunks, one after another; those of few rows are merged first when there are many."""
        if stage["chunks"] > MOST_CHUNKS:
            self._merge(stage)
        for row in self.chunks.get():
            yield _unpacked(row[0])

    def _merge(self, stage: dict) -> None:
        """Merges chunks of few rows, some at a time, and drops what later rows replaced."""
        held, small, stage["chunks"] = [], [], 0
        for row in self.chunks.get():
            rows = _unpacked(row[0])
            if len(rows) >= CHUNK_ROWS:
                held.append(row[0])
            else:
                small.append(rows)
            if sum(map(len, small)) >= 2 * CHUNK_ROWS:
                held.append(self._merged(stage, small))
                small = []
        if small:
            held.append(self._merged(stage, small))
        self.chunks.put([(x,) for x in held])

    def _merged(self, stage: dict, small: list[pa.Table]) -> bytes:
        rows = _table(_latest(_frame(small)))
        stage["chunks"] += len(rows) < CHUNK_ROWS
        return _packed(rows)

    def _all_ended(self, stage: dict) -> bool:
        """Whether as many attempts have ended as there are tasks; told twice is once."""
        if stage["ended"] < stage["num_tasks"]:
            return False
        stage["ended"] = len(np.unique(np.concatenate([np.empty(0, "int64"), *map(_ended, self._known(stage))])))
        return stage["ended"] >= stage["num_tasks"]

    def _due(self, phase: str, key, stage: dict) -> Iterator[pd.DataFrame]:
        """The facts, then the attempts in packs, without the rows that others of the same attempt replaced."""
        def handed(**given) -> pd.DataFrame:
            return pd.DataFrame([{**dict.fromkeys(_DUE), **dict(zip(STAGE_KEYS, key)), **given}], columns=_DUE)

        yield handed(phase=phase, **{c: stage[c] for c in _FACTS})
        standing, start = _standing(self._known(stage)), 0
        for rows in self._known(stage):
            here = standing[start:start + len(rows)]
            start += len(rows)
            for level, rivals in ((1, False), (2, True)):
                if (here == level).any():
                    yield handed(rivals=rivals, rows=_packed(rows.filter(pa.array(here == level))))


def due_stages(
    updates: DataFrame, stage_updates: DataFrame, th: Thresholds = Thresholds(), recheck_ms: int = RECHECK_MS,
    keep_ms: int = KEEP_MS, lateness: str = LATENESS,
) -> DataFrame:
    """Stream of what is known of the stages that are due: a row with the facts of each, and its attempts in packs.

    ``open``: a submitted, half-finished stage, at each trigger with news of it and every ``recheck_ms`` without.
    ``completed``: once per stage attempt, when all its tasks have ended or the watermark has passed its completion.  Then
    its attempts leave the state; the mark that it is done, and stages that never complete, leave ``keep_ms`` later.
    An attempt has one row, or, where rows told at one trigger differ or repeat, several in packs marked as ``rivals``.
    """
    records = attempt_rows(updates).unionByName(stage_rows(stage_updates)).withWatermark("at", lateness)
    return records.groupBy(*STAGE_KEYS).transformWithStateInPandas(
        StageState(th.finished_ratio, recheck_ms, keep_ms), DUE, "Append", "EventTime"
    )


def judge_due(
    due: DataFrame, now: int, callsites: DataFrame | None = None, th: Thresholds = Thresholds()
) -> DataFrame:
    """Statistics of the stages in a table of due ones, with ``phase``, the facts of the stage and its call site."""
    facts = due.filter("rows IS NULL").select("phase", *STAGE_KEYS, *_FACTS).withColumnRenamed("stage_failure", "failure_reason")
    key = [*STAGE_KEYS, "task_id"]
    others = [c for c in _ATTEMPT.names if c != "task_id"]
    # The packs of a stage leave the state in one task; they are dealt out before they are opened.
    parts = TASKS_PER_CORE * due.sparkSession.sparkContext.defaultParallelism
    packs = due.filter("rows IS NOT NULL").select(*STAGE_KEYS, "rivals", "rows").repartition(parts)
    told = packs.filter("NOT rivals").mapInArrow(_due_attempts, DUE_ATTEMPT).select(*key, *others)
    newest = F.max(F.struct(*others)).alias("newest")  # rivals were told at one trigger, and all have ended or all run
    rivals = packs.filter("rivals").mapInArrow(_due_attempts, DUE_ATTEMPT).groupBy(*key).agg(newest).select(*key, "newest.*")
    attempts = told.unionByName(rivals)
    stats = stages.stage_stats(tasks.snapshot_at(attempts, now), now, th, hot_rows=None)
    return rules.with_sites(facts.join(stats, STAGE_KEYS, "left"), callsites)


def due_alerts(
    judged: DataFrame, now: int, th: Thresholds = Thresholds(), host_samples: DataFrame | None = None,
    host_names: DataFrame | None = None,
) -> DataFrame:
    """Alerts of judged stages: for open ones the task rules whose largest task still runs, for completed ones all.

    With host samples, long-tail tasks that nothing explains come with the state of their host as of ``now``.
    """
    half = judged.filter(f"phase = '{OPEN}' AND n_finished >= {th.finished_ratio}D * num_tasks")
    done = judged.filter(f"phase = '{COMPLETED}' AND n_tasks > 0")
    found = [rules.task_alerts(half, now, th, only_running=True), rules.all_stage_alerts(done, now, th)]
    if host_samples is not None:
        names = hosts.host_names(host_samples) if host_names is None else host_names
        stragglers = stages.union_all(*[
            rules.unexplained_stragglers(x, now, th, only_running) for x, only_running in ((half, True), (done, False))
        ])
        if not stragglers.isEmpty():  # few triggers have one, and the samples are read for them only
            found.append(rules.straggler_alerts(stragglers, hosts.host_state_asof(stragglers, names, host_samples)))
    return stages.union_all(*found)


def due_summaries(judged: DataFrame) -> DataFrame:
    """Facts of completed stages without a failure reason, as :func:`stages.stage_summary` gives them."""
    moved = ["input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes"]
    return judged.filter(f"phase = '{COMPLETED}' AND failure_reason IS NULL").selectExpr(
        *STAGE_KEYS, "completion_ms - coalesce(submission_ms, 0L) AS elapsed_ms", "num_tasks",
        *[f"coalesce({c}, 0L) AS {c}" for c in moved], "completion_ms AS eval_ms",
    )


def stage_monitor(
    updates: DataFrame,
    stage_updates: DataFrame,
    out_path: str,
    checkpoint: str,
    at_ms: int | None = None,
    callsites: DataFrame | Callable[[SparkSession], DataFrame] | None = None,
    host_samples: Callable[[SparkSession], DataFrame] | None = None,
    host_names: DataFrame | None = None,
    th: Thresholds = Thresholds(),
    every: str | None = "3 seconds",
    recheck_ms: int = RECHECK_MS,
    keep_ms: int = KEEP_MS,
    lateness: str = LATENESS,
) -> StreamingQuery:
    """Alerts of open and completed stages to ``<out_path>/alerts``, one summary per completed stage to
    ``<out_path>/completed``, a folder per batch with something due.

    ``updates`` and ``stage_updates`` are streams of task attempts and stages; ``host_samples`` gives the samples known at a
    trigger, as :func:`host_state.recent_samples` keeps them.  ``at_ms`` fixes the evaluation time, else it is now.
    A retried batch judges the same rows again and replaces its output.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = at_ms if at_ms is not None else spark.sql("SELECT unix_millis(now()) AS t").first()["t"]
        batch = batch.persist()  # read for the facts and for the attempts
        try:
            if batch.isEmpty():
                return
            judged = judge_due(batch, now, callsites(spark) if callable(callsites) else callsites, th).persist()
            samples = None if host_samples is None else host_samples(spark)
            append_batch(due_alerts(judged, now, th, samples, host_names), f"{out_path.rstrip('/')}/alerts", batch_id)
            append_batch(due_summaries(judged), f"{out_path.rstrip('/')}/completed", batch_id)
            judged.unpersist()
        finally:
            batch.unpersist()

    with with_rocksdb(updates.sparkSession, PACKS_AT_ONCE):
        return run(due_stages(updates, stage_updates, th, recheck_ms, keep_ms, lateness), on_batch, checkpoint, every=every)
