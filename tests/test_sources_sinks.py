"""Files: event logs of real runs, executor samples, Prometheus answers, routed output."""

import subprocess
import sys
import textwrap

import pytest

from checks.fixtures import EVAL_MS
from checks.queries import _log_lines, _telemetry
from jobscope.operators import stages
from jobscope.plans import event_records
from jobscope.sinks import console_lines, deliver, route, write_executor_samples
from jobscope.sinks.executor_samples import stream_executor_samples
from jobscope.sources import (
    event_log,
    ingest_event_logs,
    ingested_tables,
    parse_event_log,
    parse_prometheus,
    read_event_log,
    read_executor_samples,
    write_tables,
)

JOB = textwrap.dedent(
    """
    import sys
    from pyspark.sql import SparkSession, functions as F
    builder = SparkSession.builder.master("local[2]").appName("logged").config("spark.ui.enabled", "false")
    for pair in sys.argv[1:]:
        key, value = pair.split("=", 1)
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.range(0, 1000, 1, 5).groupBy((F.col("id") % 7).alias("k")).count().collect()
    try:
        spark.sparkContext.parallelize(range(3), 3).map(lambda x: 1 // (x - 1)).collect()
    except Exception:
        pass
    spark.stop()
    """
)


@pytest.mark.parametrize("rolled", [False, True])
def test_event_log_round_trip(spark, tmp_path, rolled):
    conf = ["spark.eventLog.enabled=true", f"spark.eventLog.dir={tmp_path}", "spark.sql.adaptive.enabled=false",
            "spark.sql.shuffle.partitions=3"]
    if not rolled:
        conf += ["spark.eventLog.compress=false", "spark.eventLog.rolling.enabled=false"]
    subprocess.run([sys.executable, "-c", JOB, *conf], check=True, capture_output=True, timeout=180)
    tables = read_event_log(spark, str(tmp_path))
    apps = tables["applications"].collect()
    assert [a["app_name"] for a in apps] == ["logged"] and apps[0]["app_id"].startswith("local-")
    assert apps[0]["end_ms"] >= apps[0]["start_ms"]
    attempts = {(r["stage_id"], r["status"]): r["n"] for r in
                tables["task_attempts"].groupBy("stage_id", "status").agg({"*": "count"})
                .withColumnRenamed("count(1)", "n").collect()}
    assert attempts[(0, "SUCCESS")] == 5 and attempts[(1, "SUCCESS")] == 3
    assert sum(n for (_, status), n in attempts.items() if status == "FAILED") >= 1
    failed = tables["task_attempts"].filter("status = 'FAILED'").first()
    assert "ZeroDivisionError" in failed["failure_reason"] and failed["app_id"] == apps[0]["app_id"]
    stage = tables["stages"].filter("stage_id = 1").first()
    assert (stage["num_tasks"], stage["parent_ids"], stage["failure_reason"]) == (3, [0], None)
    assert tables["stage_rdds"].filter("stage_id = 0").count() >= 1
    assert tables["app_conf"].filter("key = 'spark.app.name' AND value = 'logged'").count() == 1
    written = tables["task_attempts"].groupBy("stage_id").sum("shuffle_write_records").collect()
    read = tables["task_attempts"].groupBy("stage_id").sum("shuffle_read_records").collect()
    assert dict(map(tuple, written))[0] == dict(map(tuple, read))[1] > 0

    write_tables(tables, str(tmp_path / "tables"))
    again = spark.read.parquet(str(tmp_path / "tables" / "task_attempts"))
    stats = stages.stage_stats(again, EVAL_MS).filter("stage_id = 1").first()
    assert stats["n_tasks"] == 3 and stats["time_max"] > 0


def put_log(lines, folder, name):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(f"{line}\n" for line in lines))


def rows_of(tables):
    return {name: sorted(map(str, df.select(sorted(df.columns)).collect())) for name, df in tables.items()}


def test_a_log_is_read_once(spark, tables, tmp_path, monkeypatch):
    """Reading a log scans its text once; tables, and writing them, read records by kind."""
    lines = [r["value"] for r in _log_lines(tables).filter("app_id = 'app_1'").collect()]
    put_log(lines, tmp_path / "logs" / "eventlog_v2_app_1", "events_1_app_1")
    scans = []
    real = event_log.parse_records
    monkeypatch.setattr(event_log, "parse_records", lambda *a: scans.append(1) or real(*a))
    found = read_event_log(spark, str(tmp_path / "logs"))
    assert len(scans) == 1
    for name, df in found.items():
        plan = df._jdf.queryExecution().toString()
        assert "FileScan text" not in plan and "FileScan parquet" in plan and "PartitionFilters: [kind" in plan.replace("isnotnull(kind", "kind"), name
    write_tables(found, str(tmp_path / "tables"))
    expected = rows_of(parse_event_log(_log_lines(tables).filter("app_id = 'app_1'")))
    assert rows_of({name: spark.read.parquet(str(tmp_path / "tables" / name)) for name in found}) == expected
    assert expected["task_attempts"] and expected["stage_rdds"] and expected["applications"]


def test_growing_logs_are_read_from_where_they_are_new(spark, tables, tmp_path):
    """Rolls that are closed, open, grown, renamed and repeated: several runs equal one over the final files."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    apps = {a: sorted(r["value"] for r in _log_lines(tables).filter(f"app_id = '{a}'").collect()) for a in ("app_0", "app_1")}
    first, second = apps["app_0"], apps["app_1"]
    rolled = logs / "eventlog_v2_app_0"
    put_log(first[:100], rolled, "events_1_app_0")
    put_log(first[100:150], rolled, "events_2_app_0")
    put_log(second[:70], logs, "app_1.inprogress")
    assert ingest_event_logs(spark, str(logs), out) == 1
    assert ingest_event_logs(spark, str(logs), out) is None
    put_log(first[100:300], rolled, "events_2_app_0")  # the open roll has grown
    put_log(first[300:], rolled, "events_3_app_0")
    put_log(second, logs, "app_1")  # ended: the file has its final name now
    (logs / "app_1.inprogress").unlink()
    assert ingest_event_logs(spark, str(logs), out) == 2
    found = rows_of(ingested_tables(spark, out))
    assert found == rows_of(read_event_log(spark, str(logs))) and len(found["task_attempts"]) > 500
    runs = spark.read.parquet(f"{out}/records").groupBy("run").count().collect()
    again = {r["run"]: r["count"] for r in runs}
    assert set(again) == {1, 2} and again[2] < len(first) - 100 + len(second)  # the closed roll was not read again
    spark.createDataFrame([("nonsense",)], "value string").write.text(str(logs / "eventlog_v2_app_9"))
    assert ingest_event_logs(spark, str(logs), out) == 3 and rows_of(ingested_tables(spark, out)) == found


def test_executor_samples_from_their_layout(spark, tmp_path):
    for app, executor, lines in [
        ("app_1", "3", ['{"heapMemoryTotalUsed": 123456.9, "name": "x"}', "", "not json", '{"other": 1}']),
        ("app_2", "driver", ['{"epochMillis": 17, "heapMemoryTotalUsed": 5.0E9}']),
    ]:
        folder = tmp_path / app / f"executor_{executor}"
        folder.mkdir(parents=True)
        (folder / "metrics").write_text("\n".join(lines) + "\n")
    (tmp_path / "app_1" / "server").write_text("10.0.0.1:99")
    found = {(r["app_id"], r["executor_id"], r["ts_ms"], r["heap_used"]) for r in
             read_executor_samples(spark, str(tmp_path)).collect()}
    assert found == {("app_1", "3", None, 123456), ("app_2", "driver", 17, 5_000_000_000)}


def test_executor_samples_written_twice_append(spark, tables, tmp_path):
    write_executor_samples(tables.samples, str(tmp_path))
    write_executor_samples(tables.samples, str(tmp_path))
    assert read_executor_samples(spark, str(tmp_path)).count() == 2 * tables.samples.count()


def test_executor_samples_from_a_stream(spark, tables, tmp_path):
    tables.samples.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tables.samples.schema).parquet(str(tmp_path / "in"))
    stream_executor_samples(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert all("\n" not in r["raw"] for r in read_executor_samples(spark, str(tmp_path / "out")).collect())
    back = read_executor_samples(spark, str(tmp_path / "out")).select("app_id", "executor_id", "ts_ms", "heap_used")
    assert sorted(back.collect()) == sorted(tables.samples.select(*back.columns).collect())


def test_prometheus_answers(spark):
    documents = [
        '{"status":"success","data":{"result":[{"metric":{"__name__":"node_uname_info","instance":"10.0.0.1:9100",'
        '"nodename":"host_1"},"value":[1704067200,"1.5"]},{"metric":{"instance":"i","mode":"idle"},'
        '"value":[1704067200.25,"NaN?"]}]}}',
        '{"status":"error","data":{"result":[{"metric":{"instance":"x"},"value":[1,"1"]}]}}',
        '{"status":"success","data":{"result":[]}}', "", "oops",
    ]
    found = parse_prometheus(spark.createDataFrame([(d,) for d in documents], "value string")).collect()
    assert [(r["metric"], r["instance"], r["nodename"], r["mode"], r["ts_ms"], r["value"]) for r in found] == [
        ("node_uname_info", "10.0.0.1:9100", "host_1", None, 1704067200000, 1.5),
        (None, "i", None, "idle", 1704067200250, None),
    ]


def test_routing(spark, tables):
    records = event_records(_telemetry(tables), EVAL_MS).cache()
    n = records.count()
    assert route(records, "metaServer", "there").count() == 2 * n
    assert route(records, "METASERVER", None).count() == n
    assert route(records, "metaServer", "").count() == n
    assert route(records, "other", "there").count() == n
    assert {r["sink"] for r in route(records, "Graphite", "there", 7).select("sink").distinct().collect()} == {
        "log", "graphite"
    }
    line = route(records, "graphite", "there", 7).filter("sink = 'graphite' AND event = 'APP_END'").first()["line"]
    name, value, when = line.split(" ")
    assert name.startswith("app_") and int(value) >= 0 and when == "7"


def test_delivery_to_folders(spark, tables, tmp_path):
    records = event_records(_telemetry(tables), EVAL_MS)
    deliver(records, str(tmp_path / "log"), "metaServer", str(tmp_path / "events"))
    log = spark.read.text(str(tmp_path / "log"))
    assert sorted(log.collect()) == sorted(console_lines(records).select("line").collect())
    events = spark.read.json(str(tmp_path / "events"))
    assert events.count() == records.count() and "CHANNEL@SPARK@APP_START" in {
        r["channel"] for r in events.select("channel").distinct().collect()
    }


def test_written_samples_keep_their_other_fields(spark, tmp_path):
    line = '{"epochMillis":5,"heapMemoryTotalUsed":7.0,"threads":12}'
    samples = spark.createDataFrame([("a", "1", 5, 7, line)], "app_id string, executor_id string, ts_ms bigint, heap_used bigint, raw string")
    write_executor_samples(samples, str(tmp_path / "kept"))
    assert [r["raw"] for r in read_executor_samples(spark, str(tmp_path / "kept")).collect()] == [line]
