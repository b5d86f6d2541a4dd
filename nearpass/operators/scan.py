"""Ordered scans (numbering, running sums, previous value) in two levels.

A plain window over a whole airport would put its rows into one task. Here the
window runs inside blocks (normally one day) and a small table with one row per
block carries the state from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _block_window(keys):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def running_sum(df: DataFrame, keys, block: str, order, value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` over (keys), ordered by block then ``order``."""
    keys = list(keys)
    df = df.withColumn("_v", value)
    carry = (
        df.groupBy(*keys, block).agg(F.sum("_v").alias("_n"))
        .withColumn(
            "_carry",
            F.coalesce(
                F.sum("_n").over(_block_window(keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    inner = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.withColumn("_in", F.sum("_v").over(inner))
        .join(carry, [*keys, block])
        .withColumn(out, F.col("_in") + F.col("_carry"))
        .drop("_v", "_in", "_carry")
    )


def number_rows(df: DataFrame, keys, block: str, order, out: str) -> DataFrame:
    """1-based row number over (keys), ordered by block then ``order``."""
    return running_sum(df, keys, block, order, F.lit(1), out)


def previous_value(df: DataFrame, keys, block: str, order, col: str, out: str) -> DataFrame:
    """Value of ``col`` in the row before, looking into earlier blocks when needed."""
    keys = list(keys)
    edge = (
        df.groupBy(*keys, block).agg(F.max_by(F.col(col), F.struct(*order)).alias("_last"))
        .withColumn("_prior", F.lag("_last").over(_block_window(keys).orderBy(block)))
        .drop("_last")
    )
    inner = W.partitionBy(*keys, block).orderBy(*order)
    return (
        df.withColumn("_in", F.lag(col).over(inner))
        .join(edge, [*keys, block])
        .withColumn(out, F.coalesce("_in", "_prior"))
        .drop("_in", "_prior")
    )


def latest_before(at: DataFrame, points: DataFrame, keys, t: str, block_s: int, out: str) -> DataFrame:
    """Distinct (keys, t) of ``at`` with the greatest ``t`` of ``points`` that lies before it, null where none does.

    Each second is read once per side, however many points lie within reach of it.
    """
    keys = list(keys)
    asked = at.select(*keys, t).distinct().select(*keys, t, F.lit(None).cast("bigint").alias("_p"))
    both = asked.unionByName(points.select(*keys, t).distinct().select(*keys, t, F.col(t).alias("_p"))).withColumn("_blk", F.floor(F.col(t) / block_s))
    carry = both.groupBy(*keys, "_blk").agg(F.max("_p").alias("_last")).withColumn(
        "_carry", F.max("_last").over(_block_window(keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    inner = W.partitionBy(*keys, "_blk").orderBy(t).rangeBetween(W.unboundedPreceding, -1)
    return (
        both.withColumn("_in", F.max("_p").over(inner)).filter(F.col("_p").isNull())
        .join(carry, [*keys, "_blk"])
        .select(*keys, t, F.coalesce("_in", "_carry").alias(out))
    )
