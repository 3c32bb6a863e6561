"""Runs queries beside their SQL: ``python -m checks.compare <sf_dir> [name …]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .oracles import oracle_sql
from .queries import QUERIES

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in ALL_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    return str(value)


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} sql {sorted(columns)}"
    expected, found = _bag(columns, result.fetchall()), _bag(df.columns, df.collect())
    if expected == found:
        return None
    extra, missing = found - expected, expected - found
    return (
        f"rows: spark {sum(found.values())} sql {sum(expected.values())}; "
        f"only spark {sum(extra.values())} {list(extra)[:2]}; only sql {sum(missing.values())} {list(missing)[:2]}"
    )


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = difference(df, con, sql[name]) if name in sql else f"no sql, {df.count()} rows"
            ok = problem is None or name not in sql
        except Exception as error:  # noqa: BLE001
            problem, ok = f"{type(error).__name__}: {str(error)[:600]}", False
        bad += not ok
        n = con.execute(f"SELECT count(*) FROM ({sql[name]})").fetchall()[0][0] if ok and name in sql else "?"
        print(f"{'ok ' if ok else 'BAD'} {name:28s} rows={n} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
