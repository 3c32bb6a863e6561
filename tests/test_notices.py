"""Live shuffle notices: by the time told, not by arrival."""

from jobscope.schemas import STAGES, TASK_ATTEMPTS
from jobscope.streaming import notices

ENDS = "app_id string, end_ms bigint"


def stage(spark, *rows):
    return spark.createDataFrame([("a", n, attempt, f"s{n}", 10, parents, at, None, None) for n, attempt, parents, at in rows], STAGES)


def attempts(spark, *rows):
    columns = [part.split()[0] for part in TASK_ATTEMPTS.split(", ")]
    known = {"app_id": "a"}
    made = []
    for i, (n, attempt, status, at, written) in enumerate(rows):
        row = known | {"stage_id": n, "stage_attempt_id": attempt, "task_id": i, "status": status, "finish_ms": at, "shuffle_write_bytes": written}
        made.append(tuple(row.get(c) for c in columns))
    return spark.createDataFrame(made, TASK_ATTEMPTS)


def test_notices_go_by_the_time_told(spark, tmp_path):
    root = str(tmp_path)
    given = {"stages": STAGES, "tasks": TASK_ATTEMPTS, "ends": ENDS}
    for name, schema in given.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")

    def tell(**frames):
        for name, frame in frames.items():
            frame.write.mode("append").parquet(f"{root}/{name}")
        stream = notices.notice_records(*[spark.readStream.schema(schema).parquet(f"{root}/{name}") for name, schema in given.items()])
        # Every call is a restart from the checkpoint.
        notices.read_notices(stream, f"{root}/state", f"{root}/out", f"{root}/checkpoint", lateness_ms=100, keep_ms=5000).awaitTermination()
        found = spark.read.parquet(f"{root}/out").select("stage_id", "stage_attempt_id", "message").collect()
        return sorted((r[0], r[1], r[2].split(" shuffle read ")[1]) for r in found)

    # The child is told before its parents; a failed and a running attempt write nothing, nulls are 0.
    assert tell(stages=stage(spark, (2, 0, [0, 1, 7], 1000), (3, 0, None, 1000), (4, 0, [3], 1000), (5, 0, [0], None))) == []
    assert tell(tasks=attempts(spark, (0, 0, "SUCCESS", 900, 1024), (0, 0, "FAILED", 910, 99), (1, 0, "SUCCESS", 950, 1024), (1, 0, "RUNNING", None, 50), (3, 0, "SUCCESS", 960, None))) == []
    once = tell(tasks=attempts(spark, (9, 0, "SUCCESS", 1100, 1)))
    assert [k[:2] for k in once] == [(2, 0)] and once[0][2].startswith("2")
    # Told again, or a parent told too late: nothing changes.  A second attempt has its own notice, with what is known by then.
    again = tell(stages=stage(spark, (2, 0, [0, 1, 7], 1000)), tasks=attempts(spark, (0, 0, "SUCCESS", 1200, 1024), (1, 0, "SUCCESS", 1200, 2048)))
    assert again == once
    both = tell(stages=stage(spark, (2, 1, [0, 1], 1300)), ends=spark.createDataFrame([("a", 1500)], ENDS))
    assert [k[:2] for k in both] == [(2, 0), (2, 1)] and both[1][2].startswith("5")
    # Long after the end nothing is kept of the application.
    assert tell(ends=spark.createDataFrame([("b", 7000)], ENDS)) == both
    left = [spark.read.schema(notices.ROWS).parquet(f"{root}/state/slot={i}") for i in (0, 1)]
    assert min(x.where("app_id = 'a'").count() for x in left) == 0
