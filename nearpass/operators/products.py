"""Gridded and per-day result tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from ..functions.timefns import day_text
from ..settings import VOLUME
from .intervals import interval_join, overlap_join


def daily_oe(windows: DataFrame) -> DataFrame:
    """Observed and expected encounters per UTC day over usable windows."""
    ok = windows.filter((F.col("quality") != "bad") & ~F.col("partial_coverage"))
    out = ok.groupBy(day_text(F.col("t_start")).alias("day")).agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"))
    return out.filter(F.col("expected") > 0).withColumn("oe", F.col("observed") / F.col("expected"))


def daily_range(daily: DataFrame, min_days: int = 5) -> DataFrame:
    """The range of 95 % of the days."""
    n = F.count(F.lit(1)) >= min_days
    return daily.agg(
        F.when(n, F.percentile("oe", F.lit(0.025))).alias("oe_lo"), F.when(n, F.percentile("oe", F.lit(0.975))).alias("oe_hi"))


def share_in_range(risk: DataFrame, z: str, level: float = 0.95) -> DataFrame:
    limit = NormalDist().inv_cdf(0.5 + level / 2)
    return risk.filter(F.col(z).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(z) <= limit).cast("int")).alias("share"))


def density(enc: DataFrame, events: DataFrame, window_s: int, exclusion_s: int, radius_nm: float = VOLUME.radius_nm, cells: int = 20) -> DataFrame:
    """Encounter midpoints per grid cell: away from events and just after events (each once)."""
    step = 2 * radius_nm / cells
    x, y = (F.col("xa") + F.col("xb")) / 2, (F.col("ya") + F.col("yb")) / 2

    def cell(v):
        return F.least(F.floor((v + radius_nm) / step), F.lit(cells - 1))

    pts = enc.filter((F.abs(x) <= radius_nm) & (F.abs(y) <= radius_nm)).withColumns({"ix": cell(x), "iy": cell(y)})
    t0 = events.select("t0").distinct()
    after = t0.select(F.col("t0").alias("a"), (F.col("t0") + window_s).alias("b"))
    around = t0.select((F.col("t0") - exclusion_s).alias("a"), (F.col("t0") + exclusion_s).alias("b"))
    parts = [("after", interval_join(pts, after, t="t_min", lo="a", hi="b", how="left_semi")),
             ("normal", interval_join(pts, around, t="t_min", lo="a", hi="b", how="left_anti"))]
    out = None
    for name, df in parts:
        one = df.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def traffic_around(events: DataFrame, per_second: DataFrame, half_s: int) -> DataFrame:
    """Aircraft count for every second from -half to +half around each event, zeros included."""
    secs = events.select("event_id", "t0", F.explode(F.sequence(F.col("t0") - half_s, F.col("t0") + half_s - 1)).alias("t"))
    out = secs.join(per_second.select("t", F.col("aircraft_s").alias("n")), "t", "left")
    return out.select("event_id", (F.col("t") - F.col("t0")).alias("dt"), F.coalesce("n", F.lit(0)).alias("n"))


def encounters_around(events: DataFrame, enc: DataFrame, half_s: int) -> DataFrame:
    """Encounters active at any time from -half to +half around each event."""
    spans = events.select("event_id", "t0", (F.col("t0") - half_s).alias("w_start"), (F.col("t0") + half_s).alias("w_end"))
    return overlap_join(enc, spans)
