"""Per-second traffic and its sums over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..settings import DAY_S, VOLUME, Spec, Volume
from .intervals import bins_between, interval_join, interval_sums, overlap_join


def in_volume(presence: DataFrame, spec: Spec) -> DataFrame:
    return presence.filter((F.col("r") <= spec.radius_nm) & (F.col("h") <= spec.ceiling_ft))


def per_second(presence: DataFrame, spec: Spec, *, keys=(), cfg: Volume = VOLUME) -> DataFrame:
    """Aircraft, pairs, inner pairs and long-interpolated aircraft of each second."""
    n, m = F.col("n"), F.col("n_inner")
    return (
        in_volume(presence, spec).groupBy(*keys, "t").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("r") <= cfg.inner_radius_nm).alias("n_inner"),
            F.count_if("interp_long").alias("interp_s"),
        )
        .withColumns({
            "pair_s": (n * (n - 1) / 2).cast("bigint"), "pair_s_inner": (m * (m - 1) / 2).cast("bigint"),
        })
        .withColumnRenamed("n", "aircraft_s")
    )


def presence_runs(presence: DataFrame, spec: Spec, *, keys=("day",), max_step: int = 1) -> DataFrame:
    """Unbroken stays of an aircraft in the volume, [run_start, run_end] per row.

    Counting distinct aircraft per window on a few runs per leg is far smaller
    than on aircraft-seconds.
    """
    group = [*keys, "icao24"]
    w = W.partitionBy(*group).orderBy("t")
    step = F.col("t") - F.lag("t").over(w)
    rows = (
        in_volume(presence, spec).select(*group, "t")
        .withColumn("_new", F.coalesce(step > max_step, F.lit(True)).cast("int"))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    return rows.groupBy(*group, "_run").agg(F.min("t").alias("run_start"), F.max("t").alias("run_end")).drop("_run")


def distinct_aircraft(runs: DataFrame, spans: DataFrame, *, ids=("window_id",), keys=(), bin_s: int = 600) -> DataFrame:
    """Number of different aircraft present in each span."""
    spans = spans.select(*keys, *ids, F.col("t_start").alias("w_start"), F.col("t_end").alias("w_end"))
    hits = overlap_join(runs, spans, keys=keys, left_span=("run_start", "run_end"),
                        right_span=("w_start", "w_end"), bin_s=bin_s)
    return hits.select(*ids, "icao24").distinct().groupBy(*ids).agg(F.count(F.lit(1)).alias("n_aircraft"))


def gaps_in_volume(gaps: DataFrame, presence: DataFrame, spec: Spec, *, keys=("day",), leg: str = "leg") -> DataFrame:
    """Report gaps whose leg was in the volume at the gap's first second."""
    here = in_volume(presence, spec).select(*keys, leg, F.col("t").alias("t_start"))
    return gaps.join(here, [*keys, leg, "t_start"], "left_semi")


def gap_counts(gaps: DataFrame, spans: DataFrame, *, ids=("window_id",), keys=()) -> DataFrame:
    per = gaps.groupBy(*keys, F.col("t_start").alias("t")).agg(F.count(F.lit(1)).alias("gap_count"))
    return interval_sums(per, spans, ["gap_count"], keys=keys, ids=ids)


def outage_flags(outages: DataFrame, spans: DataFrame, *, ids=("window_id",), keys=()) -> DataFrame:
    """Spans that an outage (a, b) overlaps: a < end and b > start."""
    out = outages.select(*keys, F.col("a").alias("o_start"), (F.col("b") - 1).alias("o_end"))
    spans = spans.select(*keys, *ids, F.col("t_start").alias("w_start"), F.col("t_end").alias("w_end"))
    hits = overlap_join(out, spans, keys=keys, left_span=("o_start", "o_end"), right_span=("w_start", "w_end"))
    return hits.select(*ids).distinct().withColumn("outage", F.lit(True))


def covered_seconds(spans: DataFrame, days: DataFrame, *, ids=("window_id",), keys=()) -> DataFrame:
    """Seconds of each span on days that have data. ``days`` holds (keys, day_no)."""
    pieces = spans.withColumn("day_no", F.explode(bins_between(F.col("t_start"), F.col("t_end") - 1, DAY_S)))
    part = F.least("t_end", (F.col("day_no") + 1) * DAY_S) - F.greatest("t_start", F.col("day_no") * DAY_S)
    return (
        pieces.join(days.select(*keys, "day_no"), [*keys, "day_no"])
        .groupBy(*ids).agg(F.sum(part).alias("covered_s"))
    )


def span_exposure(presence: DataFrame, spans: DataFrame, spec: Spec, *, ids=("window_id",), keys=()) -> DataFrame:
    """All additive exposure sums of each span (overlap allowed, midnight allowed)."""
    sec = per_second(presence, spec, keys=keys)
    return interval_sums(sec, spans, ["aircraft_s", "pair_s", "pair_s_inner", "interp_s"], keys=keys, ids=ids)


def own_exposure(presence: DataFrame, spans: DataFrame, spec: Spec, *, ids=("event_id", "window"), keys=()) -> DataFrame:
    """Seconds present and pair-seconds of one named aircraft (column icao24 of the span)."""
    inside = in_volume(presence, spec)
    total = inside.groupBy(*keys, "t").agg((F.count(F.lit(1)) - 1).alias("own_pair_s"))
    # only aircraft that occur in a span are kept before the per-second join
    mine = inside.select(*keys, "icao24", "t").join(spans.select(*keys, "icao24").distinct(), [*keys, "icao24"], "left_semi")
    mine = mine.join(total, [*keys, "t"]).groupBy(*keys, "icao24", "t").agg(
        F.count(F.lit(1)).alias("own_present_s"), F.sum("own_pair_s").alias("own_pair_s"))
    return interval_sums(mine, spans, ["own_present_s", "own_pair_s"], keys=(*keys, "icao24"), ids=ids)


def event_heights(presence: DataFrame, events: DataFrame, radius_nm: float, *, keys=()) -> DataFrame:
    """Highest point, seconds present and seconds beyond the radius after each event."""
    seconds = presence.select(*keys, "icao24", "t", "h", "r")
    ev = events.select(*keys, "icao24", "event_id", "t0", "t_post_end")
    hit = interval_join(seconds, ev, keys=(*keys, "icao24"), lo="t0", hi="t_post_end")
    inside = F.col("r") <= radius_nm
    agg = hit.groupBy("event_id").agg(
        F.max(F.when(inside, F.col("h"))).alias("max_height_post_ft"),
        F.count(F.lit(1)).alias("post_present_s"), F.count_if(~inside).alias("post_beyond_radius_s"),
    )
    return events.select("event_id").join(agg, "event_id", "left").fillna(0, ["post_present_s", "post_beyond_radius_s"])
