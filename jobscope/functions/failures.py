"""Failure texts: classification, advice, and the error text of a task end record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names, marker texts, reasons and solutions shown to the user.
OOM = "OOM"
FETCH = "Shuffle Fetcher ERROR"
LOST = "ExecutorLostFailure"
OOM_MARK = "Exit code is 143"
FETCH_MARKS = ["spark.shuffle.FetchFailedException", "Failed to connect to"]
LOST_MARK = "ExecutorLostFailure"
ADVICE = {
    OOM: (
        "data skew or too large",
        "check if data is skewed or boost spark.executor.memoryOverhead",
    ),
    FETCH: (
        "shuffle read data too large",
        "1) boost spark.executor.memory 2) boost spark.executor.cores "
        "3) boost spark.network.timeout 4) check if data is skewed "
        "5) avoid to use shuffle transformations if possible",
    ),
    LOST: (
        "network problem or task gc overhead",
        "boost spark.network.timeout",
    ),
}

# Fixed value: fields of a task end reason in an event log.
TASK_END_REASON = (
    "struct<Reason:string,`Full Stack Trace`:string,`Class Name`:string,Description:string,"
    "`Block Manager Address`:struct<`Executor ID`:string,Host:string,Port:int>,"
    "`Shuffle ID`:int,`Map ID`:bigint,`Map Index`:int,`Reduce ID`:int,Message:string,"
    "`Kill Reason`:string,`Job ID`:int,`Partition ID`:int,`Attempt Number`:int,"
    "`Executor ID`:string,`Exit Caused By App`:boolean,`Loss Reason`:string>"
)


def is_oom_sql(text: str) -> str:
    return f"contains({text}, '{OOM_MARK}')"


def failure_class_sql(text: str) -> str:
    fetch = " AND ".join(f"contains({text}, '{mark}')" for mark in FETCH_MARKS)
    return (
        f"CASE WHEN {is_oom_sql(text)} THEN '{OOM}' WHEN {fetch} THEN '{FETCH}' "
        f"WHEN contains({text}, '{LOST_MARK}') THEN '{LOST}' END"
    )


def failure_class(text: str) -> Column:
    """OOM, fetch failure or lost executor, tested in that order; null when none applies."""
    return F.expr(failure_class_sql(text))


def failure_advice_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN '{name}' THEN 'reason: {reason}, solutions: {solution}'"
        for name, (reason, solution) in ADVICE.items()
    )
    return f"CASE {failure_class_sql(text)} {cases} ELSE '' END"


def failure_advice(text: str) -> Column:
    """``reason: …, solutions: …`` for the class of the text, or the empty string."""
    return F.expr(failure_advice_sql(text))


def failure_text(end: str) -> Column:
    """Error text of a ``Task End Reason`` column (type ``TASK_END_REASON``); null on success."""
    def field(name: str) -> str:
        return f"{end}.`{name}`"

    def text(name: str) -> str:
        return f"coalesce(string({field(name)}), 'null')"

    address = field("Block Manager Address")
    manager = (
        f"if({address} IS NULL, 'null', concat('BlockManagerId(', {address}.`Executor ID`, ', ', {address}.Host, "
        f"', ', {address}.Port, ', None)'))"
    )
    # The texts Spark itself gives these reasons.
    texts = {
        "Success": "string(NULL)",
        "ExceptionFailure": (
            f"coalesce({field('Full Stack Trace')}, concat_ws(': ', {field('Class Name')}, {field('Description')}))"
        ),
        "FetchFailed": (
            f"concat('FetchFailed(', {manager}, ', shuffleId=', {text('Shuffle ID')}, ', mapIndex=', {text('Map Index')}, "
            f"', mapId=', {text('Map ID')}, ', reduceId=', {text('Reduce ID')}, ', message=\n', {text('Message')}, '\n)')"
        ),
        "ExecutorLostFailure": (
            f"concat('ExecutorLostFailure (executor ', {text('Executor ID')}, ' exited ', "
            f"if({field('Exit Caused By App')}, 'caused by one of the running tasks', 'unrelated to the running tasks'), ')', "
            f"coalesce(concat(' Reason: ', {field('Loss Reason')}), ''))"
        ),
        "TaskKilled": f"concat('TaskKilled (', {text('Kill Reason')}, ')')",
        "TaskCommitDenied": (
            f"concat('TaskCommitDenied (Driver denied task commit) for job: ', {text('Job ID')}, ', partition: ', "
            f"{text('Partition ID')}, ', attemptNumber: ', {text('Attempt Number')})"
        ),
        "Resubmitted": "'Resubmitted (resubmitted due to lost executor)'",
        "TaskResultLost": "'TaskResultLost (result lost from block manager)'",
    }
    cases = " ".join(f"WHEN '{kind}' THEN {sql}" for kind, sql in texts.items())
    return F.expr(f"CASE {field('Reason')} {cases} ELSE {field('Reason')} END")
