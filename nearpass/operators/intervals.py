"""Joins and sums between points in time and intervals of time.

Spark compiles a bare range condition to a nested loop. Both forms here keep an
equality key: intervals are cut at the edges of fixed time bins, and the range
test stays as a residual inside the bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bins_between(lo: Column, hi: Column, bin_s: int) -> Column:
    """Array of bin numbers touched by the closed span [lo, hi] (empty if hi < lo)."""
    a, b = F.floor(lo / bin_s), F.floor(hi / bin_s)
    return F.when(hi >= lo, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def interval_join(
    points: DataFrame, spans: DataFrame, *, keys=(), t: str = "t", lo: str = "t_start", hi: str = "t_end",
    bin_s: int = 600, closed: bool = False, how: str = "inner", extra=None,
) -> DataFrame:
    """Points inside spans: [lo, hi) or [lo, hi] when ``closed``.

    ``how`` is inner, left_semi or left_anti (seen from the points). ``extra``
    is an optional function of the aliased sides ("p", "s") giving one more
    residual condition.
    """
    end = F.col(hi) if closed else F.col(hi) - 1
    p = points.withColumn("_bin", F.floor(F.col(t) / bin_s)).alias("p")
    s = spans.withColumn("_bin", F.explode(bins_between(F.col(lo), end, bin_s))).alias("s")
    cond = (F.col("p._bin") == F.col("s._bin")) & (F.col(f"p.{t}") >= F.col(f"s.{lo}"))
    cond &= (F.col(f"p.{t}") <= F.col(f"s.{hi}")) if closed else (F.col(f"p.{t}") < F.col(f"s.{hi}"))
    for k in keys:
        cond &= F.col(f"p.{k}") == F.col(f"s.{k}")
    if extra is not None:
        cond &= extra("p", "s")
    if how != "inner":
        return p.join(s, cond, how).drop("_bin")
    cols = [F.col(f"p.{c}") for c in points.columns]
    cols += [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    return p.join(s, cond).select(*cols)


def overlap_join(
    left: DataFrame, right: DataFrame, *, keys=(), left_span=("t_start", "t_end"),
    right_span=("w_start", "w_end"), bin_s: int = 600,
) -> DataFrame:
    """Pairs of closed-left spans with left.end >= right.start and left.start < right.end.

    Both sides are cut into bins; a pair is kept only in the first bin the two
    have in common, so no duplicate removal is needed afterwards.
    """
    (la, lb), (ra, rb) = left_span, right_span
    a = left.withColumn("_bin", F.explode(bins_between(F.col(la), F.col(lb), bin_s))).alias("a")
    b = right.withColumn("_bin", F.explode(bins_between(F.col(ra), F.col(rb) - 1, bin_s))).alias("b")
    first = F.greatest(F.floor(F.col(f"a.{la}") / bin_s), F.floor(F.col(f"b.{ra}") / bin_s))
    cond = (
        (F.col("a._bin") == F.col("b._bin"))
        & (F.col("a._bin") == first)
        & (F.col(f"a.{lb}") >= F.col(f"b.{ra}"))
        & (F.col(f"a.{la}") < F.col(f"b.{rb}"))
    )
    for k in keys:
        cond &= F.col(f"a.{k}") == F.col(f"b.{k}")
    cols = [F.col(f"a.{c}") for c in left.columns]
    cols += [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, cond).select(*cols)


def interval_sums(
    points: DataFrame, spans: DataFrame, values, *, keys=(), ids=("window_id",), t: str = "t",
    lo: str = "t_start", hi: str = "t_end", block_s: int = 3600,
) -> DataFrame:
    """Sums of integer point values over [lo, hi) for any number of overlapping spans.

    ``points`` should hold one row per (keys, t). Each block of time keeps a
    running sum; a span reads it at its two edges, so the work is linear in
    points plus spans and a block never holds more than 2 * block_s rows.
    """
    keys, ids, values = list(keys), list(ids), list(values)
    pieces = spans.select(*keys, *ids, F.col(lo).alias("_a"), F.col(hi).alias("_b")).withColumn(
        "_blk", F.explode(bins_between(F.col("_a"), F.col("_b") - 1, block_s))
    )
    edges = pieces.select(
        *keys, *ids, "_blk",
        F.explode(F.array(
            F.struct(F.greatest("_a", F.col("_blk") * block_s).alias("t"), F.lit(-1).alias("sign")),
            F.struct(F.least("_b", (F.col("_blk") + 1) * block_s).alias("t"), F.lit(1).alias("sign")),
        )).alias("_e"),
    ).select(*keys, *ids, "_blk", F.col("_e.t").alias("_t"), F.col("_e.sign").alias("_sign"))
    marks = edges.select(*keys, "_blk", "_t").distinct().select(
        *keys, "_blk", "_t", F.lit(0).alias("_k"), *[F.lit(0).cast("bigint").alias(v) for v in values]
    )
    pts = points.select(
        *keys, F.floor(F.col(t) / block_s).alias("_blk"), F.col(t).alias("_t"), F.lit(1).alias("_k"),
        *[F.col(v).cast("bigint").alias(v) for v in values],
    )
    order = W.partitionBy(*keys, "_blk").orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    cum = (
        marks.unionByName(pts)
        .select(*keys, "_blk", "_t", "_k", *[F.sum(v).over(order).alias(v) for v in values])
        .filter(F.col("_k") == 0)
        .drop("_k")
    )
    return (
        edges.join(cum, [*keys, "_blk", "_t"])
        .groupBy(*ids)
        .agg(*[F.sum(F.col("_sign") * F.coalesce(v, F.lit(0))).alias(v) for v in values])
    )
