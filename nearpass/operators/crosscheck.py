"""Agreement between two detectors' event lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.plan import cut_lineage
from .intervals import interval_join


def pair_off(cand: DataFrame) -> DataFrame:
    """One-to-one pairs (event_id, det_id): events in order of time take the earliest interval that is still free.

    A pair is settled if each is the other's first choice among what is left: no earlier event can want the interval any more. Rounds settle
    all such pairs at once and go on with the rest; the earliest event of a leg is settled in every round, so there are as
    many rounds as the busiest leg has events at most.
    """
    left, settled = cut_lineage(cand.select("event_id", "det_id", "t_low", "d_start").distinct()), None
    while not left.isEmpty():
        wants = left.groupBy("event_id").agg(F.min(F.struct("d_start", "det_id")).alias("_d")).select("event_id", F.col("_d.det_id").alias("det_id"))
        takes = left.groupBy("det_id").agg(F.min(F.struct("t_low", "event_id")).alias("_e")).select("det_id", F.col("_e.event_id").alias("event_id"))
        done = cut_lineage(wants.join(takes, ["event_id", "det_id"]))
        settled = done if settled is None else settled.unionByName(done)
        left = cut_lineage(left.join(done.select("event_id"), "event_id", "left_anti").join(done.select("det_id"), "det_id", "left_anti"))
    return settled if settled is not None else left.select("event_id", "det_id")


def match_detectors(ours: DataFrame, theirs: DataFrame, pad_s: int = 90) -> DataFrame:
    """Match our low points to the other detector's intervals on the same leg, one to one.

    Candidates come from an interval join with the leg as key. Unmatched rows of both sides stay in the result.
    """
    span = theirs.select("leg_id", "det_id", "d_start", (F.col("d_start") - pad_s).alias("lo"), (F.col("d_stop") + pad_s).alias("hi"))
    cand = interval_join(ours.select("leg_id", "event_id", "t_low"), span, keys=("leg_id",), t="t_low", lo="lo", hi="hi",
                         closed=True, bin_s=3600)
    pairs = pair_off(cand)
    out = ours.select("event_id").join(pairs.select("event_id", "det_id"), "event_id", "full_outer")
    rest = theirs.select("det_id").join(pairs.select("det_id"), "det_id", "left_anti")
    out = out.unionByName(rest.select(F.lit(None).cast("string").alias("event_id"), "det_id"))
    status = F.when(F.col("det_id").isNull(), "only_ours").when(F.col("event_id").isNull(), "only_theirs").otherwise("both")
    return out.withColumn("status", status)
