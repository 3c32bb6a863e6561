"""From raw documents to token ids, in stages that are written as Parquet and read again.

Clean documents pass every stage unchanged: toxic documents go, then exact copies, then near copies but one of each
class, then documents that hold a benchmark item; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobscope.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from jobscope.llm.tables import read
from jobscope.session import materialise


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_stage(spark, docs, sf_dir)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_table(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact),
    ("minhash_near_dedup", _near),
    ("benchmark_decontamination", _benchmark),
    ("bpe", _encode),
]

# Linear models, sampling and merges have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the rows that are left, with their tokens."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
