"""Events, controls, their windows and the encounters they are involved in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dist import hash_int
from ..settings import (
    CONTROL_OUTCOMES, DAY_S, EVENT_ID_PREFIX, EVENT_OUTCOMES, EVENT_OUTCOMES_AMBIGUOUS, WINDOWS,
)
from .intervals import interval_join
from .scan import latest_before, number_rows, previous_value, running_sum
from .windows import count_columns


def anchor(df: DataFrame) -> DataFrame:
    """Anchor second t0: climb start when known, else the low point."""
    known = F.col("t_climb").isNotNull()
    return df.withColumns({
        "t0": F.coalesce("t_climb", "t_low"), "anchor": F.when(known, "climb_start").otherwise("t_low"),
    })


def _day_no(c: str) -> Column:
    return F.floor(F.col(c) / DAY_S)


def event_table(approaches: DataFrame, window_min: float, outcomes=EVENT_OUTCOMES, *, keys=(), tie="approach_id",
                contaminating=EVENT_OUTCOMES_AMBIGUOUS) -> DataFrame:
    """One row per event with window bounds, cluster membership and contamination flag."""
    w = int(window_min * 60)
    keys = list(keys)
    ev = anchor(approaches.filter(F.col("outcome").isin(*outcomes)))
    ev = number_rows(ev.withColumn("_d", _day_no("t_low")), keys, "_d", ["t_low", tie], "_n")
    prefix = None
    for name, p in EVENT_ID_PREFIX.items():
        prefix = F.when(F.col("outcome") == name, p) if prefix is None else prefix.when(F.col("outcome") == name, p)
    number = (F.col("_n") - 1).cast("string")
    ev = ev.withColumns({
        "event_id": F.concat(F.coalesce(prefix, F.lit("ev")), F.lit("_"),
                             F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)),
        "t_pre_start": F.col("t0") - w, "t_post_end": F.col("t0") + w, "_d": _day_no("t0"),
    })
    order = ["t0", "_n"]
    ev = previous_value(ev, keys, "_d", order, "t0", "_prev")
    first = F.coalesce(F.col("t0") - F.col("_prev") > w, F.lit(True))
    ev = ev.withColumn("cluster_first", first)
    ev = running_sum(ev, keys, "_d", order, first.cast("bigint"), "_c").withColumn("cluster_id", F.col("_c") - 1)
    sizes = ev.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    ev = ev.join(sizes, [*keys, "cluster_id"])
    # one earlier second tells as much as all within the window
    others = anchor(approaches.filter(F.col("outcome").isin(*contaminating))).select(*keys, "t0").filter(F.col("t0").isNotNull())
    out = ev.join(latest_before(ev, others, keys, "t0", DAY_S, "_other"), [*keys, "t0"])
    out = out.withColumn("pre_contaminated", F.coalesce(F.col("_other") >= F.col("t_pre_start"), F.lit(False)))
    return out.select(*ev.columns, "pre_contaminated").drop("_d", "_n", "_prev", "_c")


def control_table(approaches: DataFrame, exclusion_min: float, window_min: float, *, max_n: int | None = None, seed=0,
                  keys=(), tie="approach_id", outcomes=CONTROL_OUTCOMES, around=EVENT_OUTCOMES_AMBIGUOUS) -> DataFrame:
    """Full-stop landings with no event within the exclusion time on either side.

    ``max_n`` draws a seeded sample (by hash order); by default all are kept.
    """
    ex, w = int(exclusion_min * 60), int(window_min * 60)
    events = anchor(approaches.filter(F.col("outcome").isin(*around))).select(*keys, "t0").distinct()
    zone = events.select(*keys, (F.col("t0") - ex).alias("z_start"), (F.col("t0") + ex).alias("z_end"))
    ctl = approaches.filter(F.col("outcome").isin(*outcomes) & F.col("t_low").isNotNull())
    ctl = interval_join(ctl, zone, keys=keys, t="t_low", lo="z_start", hi="z_end", closed=True, bin_s=1800, how="left_anti")
    if max_n is not None:
        ctl = seeded_sample(ctl, tie, max_n, seed)
    ctl = number_rows(ctl.withColumn("_d", _day_no("t_low")), list(keys), "_d", ["t_low", tie], "_n")
    number = (F.col("_n") - 1).cast("string")
    return ctl.withColumns({
        "event_id": F.concat(F.lit("ctl_"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)),
        "kind": F.lit("control"), "anchor": F.lit("t_low"), "t0": F.col("t_low"),
        "t_pre_start": F.col("t_low") - w, "t_post_end": F.col("t_low") + w,
    }).drop("_d", "_n")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed) -> DataFrame:
    """n rows in the order of a seeded hash of the id (all rows when fewer)."""
    return df.orderBy(hash_int(seed, F.col(id_col)), F.col(id_col)).limit(n)


def event_windows(events: DataFrame, which=("pre", "post"), keep=("event_id",)) -> DataFrame:
    """Rows (event, window) for the windows early, pre and post."""
    w = F.col("t0") - F.col("t_pre_start")
    spans = {
        "early": (F.col("t_pre_start") - w, F.col("t_pre_start")),
        "pre": (F.col("t_pre_start"), F.col("t0")),
        "post": (F.col("t0"), F.col("t_post_end")),
    }
    rows = F.array(*[
        F.struct(F.lit(n).alias("window"), spans[n][0].alias("t_start"), spans[n][1].alias("t_end")) for n in which
    ])
    return events.select(*keep, F.explode(rows).alias("_w")).select(*keep, "_w.*")


def tag_encounters(enc: DataFrame, events: DataFrame, prefix: str = "ga", *, keys=(), enc_id) -> DataFrame:
    """First event whose aircraft takes part in the encounter during its pre/post span.

    Side a goes before side b, an earlier event before a later one.
    """
    enc_id = list(enc_id)
    sides = enc.select(
        *enc_id, *[k for k in keys if k not in enc_id], *(["t_min"] if "t_min" not in enc_id else []),
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("icao24_a").alias("icao24")),
            F.struct(F.lit(1).alias("side"), F.col("icao24_b").alias("icao24")),
        )).alias("_s"),
    ).select("*", "_s.side", "_s.icao24").drop("_s")
    ev = events.select(*keys, "icao24", F.col("event_id").alias("_e"), "t0", "t_pre_start", "t_post_end")
    hit = interval_join(sides, ev, keys=(*keys, "icao24"), t="t_min", lo="t_pre_start", hi="t_post_end")
    best = hit.groupBy(*enc_id).agg(
        F.min_by(
            F.struct(F.col("_e").alias("id"), F.when(F.col("t_min") < F.col("t0"), "pre").otherwise("post").alias("w")),
            F.struct("side", "t0", "_e"),
        ).alias("_b")
    ).select(*enc_id, F.col("_b.id").alias(f"{prefix}_event_id"), F.col("_b.w").alias(f"{prefix}_window"))
    return enc.join(best, enc_id, "left")


def involved_counts(enc: DataFrame, windows: DataFrame, tiers, prefix: str = "ga") -> DataFrame:
    """Encounter counts per (event, window) of the event aircraft itself, zero-filled."""
    cols = count_columns(tiers)
    agg = enc.filter(F.col(f"{prefix}_event_id").isNotNull() & F.col("inside_ceiling")).groupBy(
        F.col(f"{prefix}_event_id").alias("event_id"), F.col(f"{prefix}_window").alias("window")
    ).agg(*[F.count_if(c).alias(n) for n, c in cols.items()])
    return windows.join(agg, ["event_id", "window"], "left").fillna(0, list(cols))


def involved_frame(windows: DataFrame, counts: DataFrame, own: DataFrame, tiers) -> DataFrame:
    """Event windows with counts and exposure restricted to the event aircraft."""
    cols = list(count_columns(tiers))
    base = windows.drop(*cols, *[f"{t}_any_rate" for t in tiers], "s_min").withColumnRenamed("pair_hours", "pair_hours_airspace")
    out = base.join(counts.select("event_id", "window", *cols), ["event_id", "window"], "left")
    out = out.join(own, ["event_id", "window"], "left").fillna(0, ["own_present_s", "own_pair_s", *cols])
    out = out.withColumn("pair_hours", F.col("own_pair_s") / 3600.0).drop("own_pair_s")
    return out.withColumns({f"{t}_any_rate": F.try_divide(F.col(f"{t}_any"), F.col("pair_hours")) for t in tiers})


def exclude_windows(clock: DataFrame, event_t0: DataFrame, exclusion_min: float, *, keys=(), ids=("window_id",)):
    """(kept windows, one-row log): no event nearby, not bad, fully covered."""
    ex = int(exclusion_min * 60)
    span = clock.select(*keys, *ids, (F.col("t_start") - ex).alias("z_start"), (F.col("t_end") + ex).alias("z_end"))
    near = interval_join(event_t0.select(*keys, "t0").distinct(), span, keys=keys, t="t0", lo="z_start", hi="z_end",
                         closed=True, bin_s=3600)
    near = near.select(*ids).distinct().withColumn("_near", F.lit(True))
    flags = clock.join(near, list(ids), "left").fillna(False, ["_near"])
    bad, part, n = F.col("quality") == "bad", F.col("partial_coverage"), F.col("_near")
    keep = ~n & ~bad & ~part
    log = flags.agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(n).alias("excluded_near_event"),
        F.count_if(bad & ~n).alias("excluded_bad_quality"), F.count_if(part & ~n & ~bad).alias("excluded_partial"),
        F.count_if(keep).alias("kept"), F.count_if(keep & (F.col("pair_hours") <= 0)).alias("kept_zero_exposure"),
        F.count_if(keep & (F.col("pair_hours") > 0)).alias("kept_used"),
    )
    return flags.filter(keep).drop("_near"), log
