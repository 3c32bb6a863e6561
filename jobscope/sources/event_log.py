"""Spark event logs as telemetry tables.

A log is a text file of JSON records; rolled logs are several files in one folder, and only the
first holds the application start, so the application id comes from the path.  Compressed files
cannot be split: the unit of parallelism is the file.  A line is read and parsed once, into a table of records laid out by
kind; each telemetry table then reads the few kinds and fields it needs from there.  :func:`ingest_event_logs` does so
for logs that grow, and reads only what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.failures import TASK_END_REASON, failure_text
from ..functions.paths import app_id_from_log_path
from ..schemas import EXECUTOR_KEYS, STAGE_KEYS
from ..session import materialise

# Record names and field names of the event log format.
TASK_INFO = (
    "`Task Info` struct<`Task ID`:bigint,`Launch Time`:bigint,`Finish Time`:bigint,"
    "`Getting Result Time`:bigint,`Executor ID`:string,Host:string,Failed:boolean,Killed:boolean>"
)
TASK_METRICS = (
    "`Task Metrics` struct<`Executor Run Time`:bigint,`Executor Deserialize Time`:bigint,"
    "`Result Serialization Time`:bigint,`JVM GC Time`:bigint,"
    "`Shuffle Read Metrics`:struct<`Remote Bytes Read`:bigint,`Local Bytes Read`:bigint,`Total Records Read`:bigint>,"
    "`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint,`Shuffle Records Written`:bigint>,"
    "`Input Metrics`:struct<`Bytes Read`:bigint,`Records Read`:bigint>,"
    "`Output Metrics`:struct<`Bytes Written`:bigint>>"
)
STAGE_INFO = (
    "`Stage Info` struct<`Stage ID`:int,`Stage Attempt ID`:int,`Stage Name`:string,"
    "`Number of Tasks`:bigint,`Parent IDs`:array<int>,`Submission Time`:bigint,"
    "`Completion Time`:bigint,`Failure Reason`:string,"
    "`RDD Info`:array<struct<`RDD ID`:bigint,Callsite:string,`Parent IDs`:array<bigint>>>>"
)
STAGE_REF = "`Stage ID` int, `Stage Attempt ID` int"
RECORDS = {
    "SparkListenerApplicationStart": "`App Name` string, User string, Timestamp bigint",
    "SparkListenerApplicationEnd": "Timestamp bigint",
    "SparkListenerEnvironmentUpdate": "`Spark Properties` map<string,string>",
    "SparkListenerExecutorAdded": (
        "Timestamp bigint, `Executor ID` string, `Executor Info` struct<Host:string,`Total Cores`:int>"
    ),
    "SparkListenerExecutorRemoved": "Timestamp bigint, `Executor ID` string",
    "SparkListenerStageSubmitted": STAGE_INFO,
    "SparkListenerStageCompleted": STAGE_INFO,
    "SparkListenerTaskStart": f"{STAGE_REF}, {TASK_INFO}",
    "SparkListenerTaskEnd": f"{STAGE_REF}, `Task End Reason` {TASK_END_REASON}, {TASK_INFO}, {TASK_METRICS}",
}


# The fields of all kinds; a name means the same in each of them.
FIELDS = ", ".join([
    "`App Name` string, User string, Timestamp bigint, `Spark Properties` map<string,string>, `Executor ID` string, "
    "`Executor Info` struct<Host:string,`Total Cores`:int>", STAGE_INFO, STAGE_REF, f"`Task End Reason` {TASK_END_REASON}", TASK_INFO, TASK_METRICS,
])
PREFIX = "SparkListener"


def parse_records(lines: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Log lines (``app_id``, ``value``, others are kept) as records: ``kind`` and the fields of all kinds.

    Lines of other kinds, most of a log's bytes, are told by their first field and never parsed.
    """
    kind = F.regexp_extract("value", rf'^\s*\{{\s*"Event"\s*:\s*"{PREFIX}(\w+)"', 1)
    known = [name.removeprefix(PREFIX) for name in kinds or RECORDS]
    others = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*others, kind.alias("kind"), "value").filter(F.col("kind").isin(known))
    fields = FIELDS if kinds is None else RECORDS[kinds[0]]
    return parsed.select(*others, "kind", F.from_json("value", fields).alias("r")).select(*others, "kind", "r.*")


def _end_metrics() -> list[Column]:
    m = F.col("Task Metrics")
    read, write = m["Shuffle Read Metrics"], m["Shuffle Write Metrics"]
    fields = {
        "run_ms": m["Executor Run Time"],
        "deserialize_ms": m["Executor Deserialize Time"],
        "result_ser_ms": m["Result Serialization Time"],
        "gc_ms": m["JVM GC Time"],
        "input_bytes": m["Input Metrics"]["Bytes Read"],
        "input_records": m["Input Metrics"]["Records Read"],
        "output_bytes": m["Output Metrics"]["Bytes Written"],
        "shuffle_local_bytes": read["Local Bytes Read"],
        "shuffle_remote_bytes": read["Remote Bytes Read"],
        "shuffle_read_records": read["Total Records Read"],
        "shuffle_write_bytes": write["Shuffle Bytes Written"],
        "shuffle_write_records": write["Shuffle Records Written"],
    }
    return [F.coalesce(column, F.lit(0)).alias(name) for name, column in fields.items()]


def _attempt_ids() -> list[Column]:
    info = F.col("Task Info")
    return [
        F.col("Stage ID").alias("stage_id"), F.col("Stage Attempt ID").alias("stage_attempt_id"), info["Task ID"].alias("task_id"),
        info["Executor ID"].alias("executor_id"), info["Host"].alias("host"),
    ]


def _ended() -> list[Column]:
    """The columns of an attempt from its end record."""
    info = F.col("Task Info")
    fetching = F.coalesce(info["Getting Result Time"], F.lit(0))
    return [
        *_attempt_ids(),
        F.when(info["Failed"], "FAILED").when(info["Killed"], "KILLED").otherwise("SUCCESS").alias("status"),
        info["Launch Time"].alias("launch_ms"), info["Finish Time"].alias("finish_ms"),
        (info["Finish Time"] - info["Launch Time"]).alias("duration_ms"),
        F.when(fetching > 0, info["Finish Time"] - fetching).otherwise(F.lit(0)).alias("getting_result_ms"),
        *_end_metrics(),
        failure_text("`Task End Reason`").alias("failure_reason"),
    ]


def ended_attempts(lines: DataFrame) -> DataFrame:
    """Attempts that ended; a plain projection, so it serves streams too."""
    return parse_records(lines, ["SparkListenerTaskEnd"]).select("app_id", *_ended())


def _attempts(records: DataFrame) -> DataFrame:
    """Attempts by one aggregation of start and end records.

    The log holds no metrics of attempts without an end, so those are 0.  A record that is told twice counts once.
    """
    ends = F.col("kind") == "TaskEnd"
    whole = records.filter(F.col("kind").isin("TaskStart", "TaskEnd")).select("app_id", ends.alias("done"), *_ended())
    others = [c for c in whole.columns if c not in ("app_id", "task_id", "done")]
    last = whole.groupBy("app_id", "task_id").agg(F.max(F.struct("done", *others)).alias("last")).select("app_id", "task_id", "last.*")
    at_start = {"status": F.lit("RUNNING"), "finish_ms": F.lit(None), "duration_ms": F.lit(None), "failure_reason": F.lit(None), "getting_result_ms": F.lit(0)}
    columns = ["app_id", *[c for c in whole.columns if c not in ("app_id", "done")]]
    return last.select(*[F.when(F.col("done"), F.col(c)).otherwise(at_start[c]).alias(c) if c in at_start else F.col(c) for c in columns])


def event_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Canonical tables from records (:func:`parse_records`), each by at most one aggregation."""
    def of(*kinds: str) -> DataFrame:
        return records.filter(F.col("kind").isin(*kinds))

    def only(kind: str, value: Column) -> Column:
        return F.max(F.when(F.col("kind") == kind, value))

    queue = F.try_element_at("Spark Properties", F.lit("spark.yarn.queue"))
    start = F.struct(F.col("Timestamp").alias("ms"), "App Name", "User")
    applications = of("ApplicationStart", "ApplicationEnd", "EnvironmentUpdate").groupBy("app_id").agg(
        only("ApplicationStart", start).alias("start"), only("ApplicationEnd", F.col("Timestamp")).alias("end_ms"),
        only("EnvironmentUpdate", queue).alias("queue"),
    ).filter("start IS NOT NULL")
    added = F.struct(F.col("Timestamp").alias("ms"), F.col("Executor Info")["Host"].alias("host"), F.col("Executor Info")["Total Cores"].alias("cores"))
    executors = of("ExecutorAdded", "ExecutorRemoved").groupBy("app_id", F.col("Executor ID").alias("executor_id")).agg(
        only("ExecutorAdded", added).alias("added"), only("ExecutorRemoved", F.col("Timestamp")).alias("removed_ms"),
    ).filter("added IS NOT NULL")
    info = F.col("Stage Info")
    ids = [info["Stage ID"].alias("stage_id"), info["Stage Attempt ID"].alias("stage_attempt_id")]
    told = F.struct(
        info["Submission Time"].alias("submission_ms"), info["Stage Name"].alias("name"), info["Number of Tasks"].alias("num_tasks"),
        info["Parent IDs"].alias("parent_ids"),
    )
    done = F.struct(info["Completion Time"].alias("ms"), info["Failure Reason"].alias("failure_reason"))
    stages = of("StageSubmitted", "StageCompleted").groupBy("app_id", *ids).agg(
        only("StageSubmitted", told).alias("told"), only("StageCompleted", done).alias("done"),
    ).filter("told IS NOT NULL")
    return {
        "applications": applications.select(
            "app_id", F.col("start.App Name").alias("app_name"), F.col("start.User").alias("user"), "queue",
            F.col("start.ms").alias("submit_ms"), F.col("start.ms").alias("start_ms"), "end_ms",
        ),
        "app_conf": of("EnvironmentUpdate").select("app_id", F.explode("Spark Properties").alias("key", "value")),
        "executors": executors.select(*EXECUTOR_KEYS, "added.host", "added.cores", F.col("added.ms").alias("added_ms"), "removed_ms"),
        "stages": stages.select(
            *STAGE_KEYS, "told.name", "told.num_tasks", "told.parent_ids", "told.submission_ms",
            F.col("done.ms").alias("completion_ms"), "done.failure_reason",
        ),
        "stage_rdds": of("StageSubmitted").select("app_id", *ids, F.inline(info["RDD Info"])).select(
            *STAGE_KEYS, F.col("RDD ID").alias("rdd_id"), F.col("Parent IDs").alias("parent_ids"), F.col("Callsite").alias("callsite"),
        ),
        "task_attempts": _attempts(records),
    }


def parse_event_log(lines: DataFrame) -> dict[str, DataFrame]:
    """Canonical tables from log lines ``(app_id, value)``; each reads the lines, so write the records first if they are many."""
    return event_tables(parse_records(lines))


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    file = F.col("_metadata.file_path")
    return text.select(app_id_from_log_path(file).alias("app_id"), file.alias("file"), "value")


def read_event_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of all logs below ``path``: plain or compressed, single files or rolled folders.

    The text is read once, here: its records go to the shared folder, and the tables read them there.
    """
    records = parse_records(_lines(spark, path).drop("file"))
    return event_tables(materialise(records, "event-records", "kind"))


def stream_ended_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Attempts as they end, from finished log files moved into ``path``; a file is read once."""
    text = spark.readStream.option("recursiveFileLookup", "true").format("text").load(path)
    return ended_attempts(text.select(app_id_from_log_path(F.col("_metadata.file_path")).alias("app_id"), "value"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet table per name, so later runs read only the columns they need."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


# --- logs that grow -------------------------------------------------------------------------------

LEDGER = "file string, bytes bigint, run int"


def _folders(out: str) -> tuple[str, str]:
    return f"{out.rstrip('/')}/records", f"{out.rstrip('/')}/ledger"


def _ledger(spark: SparkSession, out: str) -> DataFrame:
    """What has been parsed: of a file that was parsed again, the last time."""
    path = _folders(out)[1]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    every = spark.read.schema(LEDGER).parquet(path)
    return every.groupBy("file").agg(F.max(F.struct("run", "bytes")).alias("last")).select("file", "last.bytes", "last.run")


def ingest_event_logs(spark: SparkSession, path: str, out: str) -> int | None:
    """Parses what is new below ``path`` into the records at ``out``; returns the number of the run, None if nothing is new.

    A ledger keeps the size each file had when it was parsed.  Closed rolls are parsed once; a file that has grown since,
    the open last roll of a running application, is parsed again and its former records no longer count, nor do those of an
    ``.inprogress`` file once it has its final name.  Records are written before the ledger, so a run that fails is made
    again from the start and leaves nothing behind that counts.
    """
    records, ledger = _folders(out)
    known = _ledger(spark, out).persist()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_replace("path", "^(file|hdfs|s3a?|abfss?):/*", "$1:/").alias("file"), F.col("path").alias("place"), F.col("length").alias("bytes")
    )
    new = listed.join(known.select("file", "bytes"), ["file", "bytes"], "left_anti")
    places = [(r["file"], r["place"], r["bytes"]) for r in new.collect()]  # names of new files, as any reader lists them
    if not places:
        known.unpersist()
        return None
    number = (known.agg(F.max("run")).first()[0] or 0) + 1
    parsed = parse_records(_lines(spark, *[place for _, place, _ in places]))
    named = parsed.withColumn("file", F.regexp_replace("file", "^(file|hdfs|s3a?|abfss?):/*", "$1:/"))
    named.write.mode("overwrite").partitionBy("kind").parquet(f"{records}/run={number}")
    spark.createDataFrame([(file, size, number) for file, _, size in places], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    known.unpersist()
    return number


def ingested_records(spark: SparkSession, out: str) -> DataFrame:
    """The records that count: of each file those of the run that parsed it last."""
    records, _ = _folders(out)
    last = _ledger(spark, out).select("file", "run")
    final = last.filter("NOT file LIKE '%.inprogress'").select(F.concat("file", F.lit(".inprogress")).alias("file"))
    return spark.read.schema(f"app_id string, file string, {FIELDS}, run int, kind string").parquet(records).join(
        last.join(final, "file", "left_anti"), ["file", "run"], "left_semi"
    ).drop("file", "run")


def ingested_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Canonical tables of all that :func:`ingest_event_logs` has parsed."""
    return event_tables(ingested_records(spark, out))
