"""Host metrics from answers of a Prometheus query, one JSON document per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shape of an answer.
ANSWER = (
    "status string, data struct<result:array<struct<metric:map<string,string>,value:array<string>>>>"
)


def parse_prometheus(documents: DataFrame) -> DataFrame:
    """Host samples from documents in ``value``; failed or empty answers make no rows."""
    rows = (
        documents.select(F.from_json("value", ANSWER).alias("answer"))
        .filter(F.col("answer.status") == "success")
        .select(F.inline("answer.data.result"))
    )
    seconds = F.get("value", 0).try_cast("double")
    return rows.select(
        F.col("metric")["__name__"].alias("metric"),
        F.col("metric")["instance"].alias("instance"),
        F.col("metric")["nodename"].alias("nodename"),
        F.col("metric")["mode"].alias("mode"),
        F.col("metric")["cpu"].alias("cpu"),
        F.round(seconds * 1000).cast("bigint").alias("ts_ms"),
        F.get("value", 1).try_cast("double").alias("value"),
    )
