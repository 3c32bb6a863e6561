"""Call site of a stage: a walk up its RDD lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import STAGE_KEYS
from ..session import materialise

# Stages of up to so many RDDs are walked within a row, larger ones by joins; the answers are the same.
IN_ROW = 512


def _known(rdds: DataFrame) -> DataFrame:
    """Each RDD of a stage once: of rows told again, the one that is last by call site, then parents."""
    last = F.max(F.struct("callsite", "parent_ids")).alias("last")
    return rdds.groupBy(*STAGE_KEYS, "rdd_id").agg(last).select(*STAGE_KEYS, "rdd_id", "last.callsite", "last.parent_ids")


def _next_rdds(rdds: DataFrame) -> DataFrame:
    """``(stage, rdd_id, next_id)``: the only parent if it lies in the stage, else null."""
    pointers = rdds.select(*STAGE_KEYS, "rdd_id",
                           F.when(F.size("parent_ids") == 1, F.col("parent_ids")[0]).alias("parent_id"))
    members = rdds.select(*STAGE_KEYS, F.col("rdd_id").alias("parent_id"), F.col("rdd_id").alias("next_id"))
    return pointers.join(members, [*STAGE_KEYS, "parent_id"], "left").select(*STAGE_KEYS, "rdd_id", "next_id")


def _walk(pointers: DataFrame) -> DataFrame:
    """The pointers of a stage as one map in a row of bounded size, followed from its highest RDD id.

    A walk has at most as many steps as the stage has pointers; one that is not done by then is on a circle.
    """
    steps = F.collect_list(F.when(F.col("next_id").isNotNull(), F.struct("rdd_id", "next_id")))
    gathered = pointers.groupBy(*STAGE_KEYS).agg(F.map_from_entries(steps).alias("steps"), F.max("rdd_id").alias("top"))
    stop = F.aggregate(
        F.sequence(F.lit(0), F.size("steps")),
        F.struct(F.col("top").alias("at"), F.lit(False).alias("done")),
        lambda state, _: F.when(state["done"], state).otherwise(
            F.struct(F.coalesce(F.try_element_at("steps", state["at"]), state["at"]).alias("at"),
                     F.try_element_at("steps", state["at"]).isNull().alias("done"))
        ),
        lambda state: state["at"],
    )
    return gathered.select(*STAGE_KEYS, stop.alias("rdd_id"))


def _doubled(pointers: DataFrame, most: int) -> DataFrame:
    """The same by pointer doubling: each round every RDD points twice as far, for stages of any size.

    After as many rounds as the binary digits of the largest stage, everything points to its end or into its circle.
    """
    ends = F.col("next_id").isNull()
    far = materialise(pointers.select(*STAGE_KEYS, "rdd_id", F.coalesce("next_id", "rdd_id").alias("far"), ends.alias("done")), "rdd-pointers")
    for _ in range(most.bit_length()):
        ahead = far.select(*STAGE_KEYS, F.col("rdd_id").alias("far"), F.col("far").alias("beyond"), F.col("done").alias("there"))
        open_ = far.filter("NOT done").join(ahead, [*STAGE_KEYS, "far"]).select(
            *STAGE_KEYS, "rdd_id", F.col("beyond").alias("far"), F.col("there").alias("done")
        )
        far = materialise(far.filter("done").unionByName(open_), "rdd-pointers")
        if far.filter("NOT done").isEmpty():
            break
    return far.groupBy(*STAGE_KEYS).agg(F.max_by("far", "rdd_id").alias("rdd_id"))


def stage_callsites(rdds: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """``(stage, rdd_id, callsite)`` of the RDD where the walk from the highest RDD id stops.

    The walk goes on while the RDD has exactly one parent and that parent is in the stage.  A walk that runs into a
    circle ends on it.  A stage without RDDs has no row; an RDD told twice counts once.
    """
    known = _known(rdds)
    sizes = rdds.groupBy(*STAGE_KEYS).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > in_row)
    most = large.agg(F.max("n")).first()[0]
    pointers = _next_rdds(known)
    if most is None:
        stops = _walk(pointers)
    else:
        keys = large.select(*STAGE_KEYS)
        stops = _walk(pointers.join(keys, STAGE_KEYS, "left_anti")).unionByName(
            _doubled(pointers.join(keys, STAGE_KEYS, "left_semi"), most)
        )
    return stops.join(known.select(*STAGE_KEYS, "rdd_id", "callsite"), [*STAGE_KEYS, "rdd_id"]).select(
        *STAGE_KEYS, "rdd_id", "callsite"
    )
