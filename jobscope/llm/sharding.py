"""Uniform shuffle into shards of exact sizes: a communication matrix with hypergeometric law says how many rows of
each source block go to each shard; blocks are permuted, exchanged, and permuted again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

# Rows that one task orders at a time, about.
BLOCK_ROWS = 250_000
MAX_BLOCKS = 65_536


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without return from ``good`` + ``bad``, are good; any sizes.

    The law is computed outward from its mode by the ratio of neighbours, over 12 standard deviations on each side.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = draws * (good / total) * (bad / total) * (total - draws) / max(total - 1, 1)
    reach = int(12 * spread**0.5) + 30
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    fall = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    law = np.concatenate([fall[::-1], [1.0], rise])
    place = int(np.searchsorted(np.cumsum(law), rng.random() * law.sum(), side="right"))
    return mode - len(fall) + min(place, len(law) - 1)


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, distributed as a uniform random permutation makes them."""
    rng = np.random.default_rng(seed)
    left = [int(s) for s in shards]
    matrix = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for i, n in enumerate(rows):
        n, rest = int(n), sum(left)
        for j, room in enumerate(left):
            rest -= room
            take = hypergeometric(rng, room, rest, n) if n else 0
            matrix[i, j], left[j], n = take, room - take, n - take
    return matrix


def assign_shards(rows: DataFrame, shards: int, key: list[str], seed: int = 7) -> DataFrame:
    """``rows`` with ``shard`` (0 …) and ``slot`` (gapless from 0 in each shard); columns of these names are replaced.

    Shard sizes differ by one at most, and any two assignments with these sizes are equally likely over seeds.  The
    order is a function of the values in ``key`` (which should tell rows apart) and the seed, so a repeated task gives
    the same answer; rows that agree in ``key`` are interchangeable, each gets its own slot.  Nulls are values like
    others.  An empty table gives an empty result.  The driver holds one count per block, MAX_BLOCKS at most.
    """
    spark = rows.sparkSession
    draw = lambda part: F.xxhash64(F.lit(f"{seed}:{part}"), *[F.struct(F.col("row")[k].isNull(), F.col("row")[k]) for k in key])
    # The row as one column, so that its names can't meet ours.
    rows = rows.drop("shard", "slot").select(F.struct("*").alias("row"))
    by_key = [F.col("row")[k] for k in key]
    total = rows.count()
    blocks = int(min(MAX_BLOCKS, max(24, -(-total // BLOCK_ROWS))))
    dealt = rows.withColumns({"block": F.pmod(draw("block"), F.lit(blocks)).cast("int"), "local": draw("local")})
    counts = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count("*").alias("n")).collect()}
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    ends = matrix.cumsum(axis=1)
    ends_table = spark.createDataFrame([(b, [int(x) for x in ends[b]]) for b in range(blocks)], "block int, ends array<bigint>")
    # First permutation: the rank inside the block, cut by the block's row of the matrix.
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("local", *by_key)))
    sent = ranked.join(ends_table, "block").withColumn(
        "shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int")
    ).select("row", "shard")
    # Second permutation: a slice of random order first, then the rank inside the slice.
    slices = int(max(1, -(-total // (shards * BLOCK_ROWS))))
    sent = sent.withColumns({"slice": F.pmod(draw("slice"), F.lit(slices)).cast("int"), "order": draw("order")})
    before = sent.groupBy("shard", "slice").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")
    ).drop("n")
    placed = sent.withColumn("place", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("order", *by_key)))
    return placed.join(before, ["shard", "slice"]).select("row.*", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order within each file."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign_shards(rows, 24, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
