"""Scalar functions at their boundaries, with literal expectations."""

import pytest
from pyspark.sql import functions as F

from jobscope.functions import (
    app_id_from_log_path,
    app_id_from_sample_path,
    executor_id_from_path,
    failure_advice,
    failure_class,
    failure_text,
    fmt_bytes,
    fmt_duration,
    parse_size,
)
from jobscope.functions.failures import TASK_END_REASON
from jobscope.functions.text import message_sql


def values(spark, type_, inputs, column):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {type_}").select("i", column.alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


def test_fmt_bytes(spark):
    cases = {
        -5: "-5 B", 0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 1152: "1.12 KB", 1157: "1.13 KB",
        1536: "1.50 KB", 1048575: "1024.00 KB", 1048576: "1.00 MB", 1073741824: "1.00 GB",
        1099511627776: "1.00 TB", 5 * 1024**5: "5120.00 TB",
    }
    assert values(spark, "bigint", cases, fmt_bytes("x")) == list(cases.values())


def test_fmt_duration(spark):
    cases = {
        -1: "-1 ms", 0: "0 ms", 999: "999 ms", 1000: "1 secs ", 1999: "1 secs ", 60000: "1 mins ",
        61000: "1 mins 1 secs ", 3600000: "1 hour ", 90061000: "1 day 1 hour 1 mins 1 secs ",
        86400000 * 40: "40 day ",
    }
    assert values(spark, "bigint", cases, fmt_duration("x")) == list(cases.values())


def test_parse_size(spark):
    cases = {
        "17": 17, "1b": 1, "4k": 4096, "4kb": 4096, "2M": 2097152, "2mb": 2097152, "4g": 4294967296,
        "1gb": 1073741824, "1t": 1099511627776, "1p": 1125899906842624, " 1pb ": 1125899906842624,
        "x": None, "": None, "1.5g": None, "4gg": None, "99999999999999999999": None,
    }
    assert values(spark, "string", cases, parse_size("x")) == list(cases.values())


def test_failure_class_and_advice(spark):
    fetch = "org.apache.spark.shuffle.FetchFailedException: Failed to connect to h"
    cases = {
        "Exit code is 143 ExecutorLostFailure": "OOM",
        fetch: "Shuffle Fetcher ERROR",
        "org.apache.spark.shuffle.FetchFailedException": None,
        "Failed to connect to h": None,
        "ExecutorLostFailure (executor 3)": "ExecutorLostFailure",
        "other": None,
    }
    assert values(spark, "string", cases, failure_class("x")) == list(cases.values())
    advice = values(spark, "string", cases, failure_advice("x"))
    assert advice[0] == (
        "reason: data skew or too large, solutions: check if data is skewed or boost spark.executor.memoryOverhead"
    )
    assert advice[1].startswith("reason: shuffle read data too large, solutions: 1) boost spark.executor.memory 2)")
    assert advice[2:4] == ["", ""]
    assert advice[4] == "reason: network problem or task gc overhead, solutions: boost spark.network.timeout"


@pytest.mark.parametrize(
    ("record", "text"),
    [
        ('{"Reason":"Success"}', None),
        ('{"Reason":"Resubmitted"}', "Resubmitted (resubmitted due to lost executor)"),
        ('{"Reason":"TaskResultLost"}', "TaskResultLost (result lost from block manager)"),
        ('{"Reason":"UnknownReason"}', "UnknownReason"),
        ('{"Reason":"TaskKilled","Kill Reason":"speculation"}', "TaskKilled (speculation)"),
        ('{"Reason":"ExceptionFailure","Class Name":"E","Description":"d"}', "E: d"),
        ('{"Reason":"ExceptionFailure","Full Stack Trace":"E: d\\n at x"}', "E: d\n at x"),
        (
            '{"Reason":"TaskCommitDenied","Job ID":1,"Partition ID":2,"Attempt Number":3}',
            "TaskCommitDenied (Driver denied task commit) for job: 1, partition: 2, attemptNumber: 3",
        ),
        (
            '{"Reason":"FetchFailed","Block Manager Address":{"Executor ID":"1","Host":"h","Port":7},'
            '"Shuffle ID":4,"Map ID":5,"Map Index":6,"Reduce ID":8,"Message":"m"}',
            "FetchFailed(BlockManagerId(1, h, 7, None), shuffleId=4, mapIndex=6, mapId=5, reduceId=8, message=\nm\n)",
        ),
        (
            '{"Reason":"FetchFailed","Shuffle ID":4,"Map ID":5,"Map Index":6,"Reduce ID":8,"Message":"m"}',
            "FetchFailed(null, shuffleId=4, mapIndex=6, mapId=5, reduceId=8, message=\nm\n)",
        ),
        (
            '{"Reason":"ExecutorLostFailure","Executor ID":"9","Exit Caused By App":true,"Loss Reason":"gone"}',
            "ExecutorLostFailure (executor 9 exited caused by one of the running tasks) Reason: gone",
        ),
        (
            '{"Reason":"ExecutorLostFailure","Executor ID":"9","Exit Caused By App":false}',
            "ExecutorLostFailure (executor 9 exited unrelated to the running tasks)",
        ),
    ],
)
def test_failure_text(spark, record, text):
    df = spark.createDataFrame([(record,)], "x string").select(F.from_json("x", TASK_END_REASON).alias("e"))
    assert df.select(failure_text("e").alias("y")).first()["y"] == text


def test_paths(spark):
    paths = ["/m/app_1/executor_7/metrics", "executor_7", "/m/app_1/my_executor_7/metrics",
             "file:/m/app_id=app_1/executor_id=7/part-0.json", "/m/app_1/server"]
    assert values(spark, "string", paths, executor_id_from_path(F.col("x"))) == ["7", "7", None, "7", None]
    assert values(spark, "string", paths, app_id_from_sample_path(F.col("x"))) == ["app_1", None, None, "app_1", None]
    logs = ["file:/l/eventlog_v2_app-1/events_1_app-1.zstd", "/l/application_1_2", "/l/app-3.inprogress", "/l/app-4.lz4"]
    assert values(spark, "string", logs, app_id_from_log_path(F.col("x"))) == ["app-1", "application_1_2", "app-3", "app-4"]


def test_message_quotes_and_nulls(spark):
    df = spark.createDataFrame([("it's", None)], "a string, b int")
    assert df.selectExpr(f"{message_sql("don't \\ {a} {b}.")} AS m").first()["m"] == "don't \\ it's ."
