"""Exact dedup by a tree merge of sorted digest runs: partitions exchange runs in rounds, merge them, and keep the
verified best identifier of each digest at every level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import partitions, read

FAN_IN = 8
SAME = ("digest", "n_bytes", "check_hash")


def _digits(slots: int) -> int:
    n, size = 1, FAN_IN
    while size < slots:
        n, size = n + 1, size * FAN_IN
    return n


def _heads(run: pa.RecordBatch) -> np.ndarray:
    """Where the entries of each digest begin in a piece of a sorted run."""
    fresh = np.ones(run.num_rows, dtype=bool)
    fresh[1:] = False
    for name in SAME:
        column = run.column(name)
        fresh[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, run.num_rows - 1)))
    return np.flatnonzero(fresh)


def _merge_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each digest of a sorted run: its first one, which has the best identifier, and the sum of their sizes.

    Of what came before, only the last entry is held.
    """
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        heads, place = _heads(batch), batch.schema.get_field_index("group_size")
        sizes = np.add.reduceat(np.asarray(batch.column(place)), heads)
        merged = batch.take(pa.array(heads))
        merged = merged.set_column(place, batch.schema.field(place), pa.array(sizes, pa.int64()))
        held = merged.slice(merged.num_rows - 1)
        yield merged.slice(0, merged.num_rows - 1)
    if held is not None:
        yield held


def _run(entries: DataFrame, keep: str) -> DataFrame:
    """Each partition as one sorted run without repeated digests.

    The order is digest, then best identifier (a null one last).  Spark's sorter does the multiway merge of what came from
    the partners, from disk where it does not fit in memory.
    """
    best = F.col("keep_id").desc_nulls_last() if keep == "max" else F.col("keep_id").asc_nulls_last()
    return entries.sortWithinPartitions(*SAME, best).mapInArrow(_merge_entries, entries.schema)


def tree_merge(digests: DataFrame, rounds: int, keep: str = "max") -> DataFrame:
    """One row per digest: ``digest``, ``n_bytes``, ``check_hash``, ``keep_id``, ``group_size``.

    ``digests`` has ``digest`` (hex), ``n_bytes``, ``check_hash`` and ``id``.  Each partition first turns its own rows into
    a sorted run, so a digest that fills a third of the table leaves a partition as one entry, whatever its ids are.  Slots
    are the numbers of ``rounds`` digits to the base FAN_IN; a run starts in the slot of its partition's number.  In round
    r a slot sends each entry to that one of FAN_IN partners whose digit r is that of the digest, and merges the
    FAN_IN sorted runs that it gets: of a digest at most one entry from each partner (in the first round, from each run
    that starts there).  After the last round a slot owns all of its digests.  Entries are merged only if digest, length
    and a second hash agree.
    """
    slots = FAN_IN**rounds
    state = digests.select(*SAME, F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    state = _run(state, keep).withColumn("slot", F.spark_partition_id() % slots)
    for r in range(rounds):
        unit = FAN_IN**r
        owner = F.conv(F.substring("digest", 2 * r + 1, 2), 16, 10).cast("int") % FAN_IN
        digit = F.floor(F.col("slot") / unit).cast("int") % FAN_IN
        state = state.withColumn("slot", F.col("slot") + (owner - digit) * unit)
        state = _run(state.repartitionById(slots, F.col("slot")), keep)
    return state.drop("slot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Every row's ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, dropped ones too.

    Texts are equal when identical; null counts as the empty text.  Of a group the row with the largest id stays
    (``keep="min"``: the smallest).  A null id stays only in a group that has no other; rows that repeat an id with
    the same text are each returned, ``kept`` alike.  Only digests are exchanged, never texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = docs.select(
        F.col(id_col).alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"), F.xxhash64(text).alias("check_hash"),
    )
    rounds = min(16, _digits(partitions(docs.sparkSession)))
    groups = tree_merge(digests, rounds, keep)
    # Rows that are alone in their group need no answer, so only repeated digests are looked up.
    repeated = groups.where("group_size > 1").select(
        F.col("digest").alias("digest_"), F.col("n_bytes").alias("n_bytes_"), F.col("check_hash").alias("check_hash_"),
        "keep_id", "group_size",
    )
    joined = digests.join(
        repeated,
        (F.col("digest") == F.col("digest_")) & (F.col("n_bytes") == F.col("n_bytes_")) & (F.col("check_hash") == F.col("check_hash_")),
        "left",
    )
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; the kept rows and columns are unchanged.

    Rows that repeat both id and text cannot be told apart by id: one of them stays.
    """
    row_key = lambda id_, digest: F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("null")), digest)
    gone = exact_groups(docs, id_col, text_col, keep).where("NOT kept").select(row_key(F.col(f"`{id_col}`"), F.col("text_sha256")).alias("key"))
    whole = docs.select(F.struct("*").alias("row"))  # names of columns can't meet those of the join
    digest = F.sha2(F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary"), 256)
    rest = whole.withColumn("key", row_key(F.col("row")[id_col], digest)).join(gone, "key", "left_anti")
    return rest.dropDuplicates(["key"]).select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
