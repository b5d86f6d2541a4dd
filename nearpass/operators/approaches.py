"""Approach attempts of each leg and their outcomes.

Input rows (one per report of a leg): day, leg, icao24, t, x, y, track, agl,
vrate, groundspeed, onground. A leg is bounded by one day of one aircraft.
"""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geo
from ..functions.plan import pin
from ..settings import APPROACH, Approach
from .intervals import interval_join

LEG = ["day", "leg"]
APP = ["day", "leg", "start"]
#: One measured approach; numbers first, as they sort faster than texts.
SPAN = ["leg", "start", "day", "end", "runway", "icao24"]


def with_row_index(points: DataFrame) -> DataFrame:
    """Row number inside the leg and the leg's last report."""
    w = W.partitionBy(*LEG)
    return points.withColumns({
        "i": F.row_number().over(w.orderBy("t")),
        "t_next": F.lead("t").over(w.orderBy("t")),
        "tail": F.max(F.struct("t", "agl", "vrate")).over(w),
    })


def aligned_points(points: DataFrame, runways, cfg: Approach = APPROACH) -> DataFrame:
    """Points on final to some runway end, with the best matching end."""
    frame = {}
    for k, (_, tx, ty, bearing) in enumerate(runways):
        along, cross = geo.runway_frame(F.col("x") - tx, F.col("y") - ty, bearing)
        frame |= {f"_al{k}": along, f"_cr{k}": F.abs(cross), f"_tu{k}": geo.track_delta(F.col("track"), bearing)}
    p = pin(points.filter(F.col("agl") < cfg.max_agl_ft), frame)
    options = [
        F.when(
            (F.col(f"_al{k}") > cfg.past_threshold_nm) & (F.col(f"_al{k}") < cfg.max_dist_nm)
            & (F.col(f"_cr{k}") < cfg.max_xtrack_nm) & (F.col(f"_tu{k}") < cfg.max_track_deg),
            F.struct((F.col(f"_tu{k}") + cfg.xtrack_weight * F.col(f"_cr{k}")).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name")),
        )
        for k, (name, *_) in enumerate(runways)
    ]
    p = pin(p, {"runway": F.array_min(F.array(*options))["name"]}).drop(*frame)
    return p.filter(F.col("runway").isNotNull())


def detect_approaches(rows: DataFrame, runways, cfg: Approach = APPROACH) -> DataFrame:
    """One row per approach attempt: start, end and runway by weighted vote."""
    al = aligned_points(rows, runways, cfg)
    w = W.partitionBy(*LEG).orderBy("t")
    al = al.withColumn("_new", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0)) > cfg.merge_gap_s).cast("int"))
    al = al.withColumn("grp", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    weight = F.when(F.col("agl") < cfg.low_vote_agl_ft, cfg.low_vote_weight).otherwise(1.0)
    votes = al.groupBy(*LEG, "icao24", "grp", "runway").agg(
        F.sum(weight).alias("votes"), F.min("t").alias("seen"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    spans = votes.groupBy(*LEG, "icao24", "grp").agg(
        F.max_by("runway", F.struct(F.col("votes"), -F.col("seen"))).alias("runway"),
        F.min("seen").alias("start"), F.max("last").alias("end"), F.sum("n").alias("n_aligned"),
    ).filter((F.col("n_aligned") >= 2) & (F.col("end") - F.col("start") >= cfg.min_duration_s))
    # heights over every row of the span, aligned or not
    inside = interval_join(rows.select(*LEG, "t", "agl"), spans, keys=LEG, lo="start", hi="end", closed=True)
    heights = inside.groupBy(*APP).agg(F.min("agl").alias("_lo"), F.max("agl").alias("_hi"))
    ok = heights.filter((F.col("_lo") <= cfg.min_reached_agl_ft) & (F.col("_hi") - F.col("_lo") >= cfg.min_descent_ft))
    return spans.join(ok.select(*APP), APP).drop("grp", "n_aligned")


def truncated_finals(rows: DataFrame, found: DataFrame, runways, cfg: Approach = APPROACH) -> DataFrame:
    """Legs that end low near the field without a detected approach covering the end."""
    w = W.partitionBy(*LEG).orderBy(F.desc("i"))
    back = rows.withColumn("_r", F.row_number().over(w))
    recent = F.col("_r") <= cfg.truncated_tail_rows
    turn = {
        f"_td{k}": F.percentile(F.when(F.col("_r") <= cfg.truncated_track_rows, geo.track_delta(F.col("track"), b)), F.lit(0.5))
        for k, (_, _, _, b) in enumerate(runways)
    }
    last = F.col("tail.t")
    legs = back.groupBy(*LEG, "icao24").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("t", "agl", "x", "y"))).alias("z"),
        F.percentile(F.when(recent, F.col("vrate")), F.lit(0.5)).alias("_vr"),
        F.min(F.when(F.col("t") >= last - cfg.truncated_segment_s, F.col("t"))).alias("start"),
        *[c.alias(n) for n, c in turn.items()],
    )
    best = F.array_min(F.array(*[
        F.when(F.col(f"_td{k}") < cfg.truncated_track_deg, F.struct(F.col(f"_td{k}").alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name")))
        for k, (name, *_) in enumerate(runways)
    ]))["name"]
    legs = legs.filter(
        (F.col("z.agl") <= cfg.truncated_agl_ft) & (F.hypot("z.x", "z.y") <= cfg.truncated_dist_nm)
        & (F.coalesce(F.col("_vr"), F.lit(0.0)) <= cfg.end_truncated_vrate_fpm)
    )
    covered = found.groupBy(*LEG).agg(F.max("end").alias("_end"))
    legs = legs.join(covered, LEG, "left").filter(
        F.col("_end").isNull() | (F.col("z.t") - F.col("_end") >= cfg.truncated_covered_s))
    return legs.select(*LEG, "icao24", F.coalesce(best, F.lit("")).alias("runway"), "start", F.col("z.t").alias("end"))


def _first(cond, *fields):
    """Earliest row (by index) meeting a condition."""
    return F.min(F.when(cond, F.struct("i", *fields)))


def measure(rows: DataFrame, spans: DataFrame, cfg: Approach = APPROACH) -> DataFrame:
    """Profile metrics of each approach over its segment and the aftermath.

    All steps are windows on one approach; runs are found from row-index gaps,
    durations from seconds. A task keeps every sort of its rows until it ends, so
    the steps follow each other in two orders only: by row, then by climbing run.
    """
    zone = spans.withColumn("_until", F.col("end") + cfg.aftermath_s)
    used = ["t", "x", "y", "agl", "vrate", "groundspeed", "onground", "i", "t_next", "tail"]
    p = interval_join(rows.select(*LEG, *used), zone, keys=LEG, lo="start", hi="_until", closed=True).select(*SPAN, *used)
    by_row = W.partitionBy(*SPAN).orderBy("i")
    all_ = by_row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    run = by_row.rowsBetween(W.unboundedPreceding, 0)
    before = by_row.rowsBetween(W.unboundedPreceding, -1)
    seg = F.col("t") <= F.col("end")
    p = p.withColumn("low", F.min(F.when(seg & F.col("agl").isNotNull(), F.struct("agl", "i", "t", "x", "y"))).over(all_))
    p = p.withColumns({
        "band": F.coalesce(F.col("agl") <= F.col("low.agl") + cfg.plateau_band_ft, F.lit(False)),
        "climb": F.coalesce(F.col("vrate") >= cfg.climb_vrate_fpm, F.lit(False)) & (F.col("i") >= F.col("low.i")),
    })

    def run_no(flag, gap):
        prev = F.last(F.when(F.col(flag), F.col("i")), ignorenulls=True).over(before)
        return (F.col(flag) & F.coalesce(F.col("i") - prev > gap, F.lit(True))).cast("int")

    p = p.withColumns({"_nb": run_no("band", cfg.plateau_row_gap), "_nc": run_no("climb", cfg.climb_row_gap)})
    p = p.withColumns({"brun": F.sum("_nb").over(run), "crun": F.sum("_nc").over(run)})
    p = p.withColumn("low_run", F.max(F.when(F.col("i") == F.col("low.i"), F.col("brun"))).over(all_))
    climbing = W.partitionBy(*SPAN, "crun")
    p = p.withColumns({
        "_c0": F.min(F.when(F.col("climb"), F.col("t"))).over(climbing),
        "_c1": F.max(F.when(F.col("climb"), F.col("t"))).over(climbing),
    })
    good = F.col("climb") & (F.col("_c1") - F.col("_c0") >= cfg.climb_min_s) & (F.col("_c0") - F.col("low.t") <= cfg.climb_within_s)
    p = p.withColumn("cs", _first(good, "t", "agl", "x", "y").over(W.partitionBy(*SPAN)))
    plateau = F.col("band") & (F.col("brun") == F.col("low_run"))
    upto = F.col("i") <= F.col("low.i")
    above = F.when(upto & (F.col("agl") > F.col("low.agl") + cfg.plateau_band_ft), F.struct("i", "t_next"))
    in_peak = (F.col("i") >= F.col("cs.i")) & (F.col("i") < F.col("cs.i") + cfg.peak_rows)
    m = p.groupBy(*SPAN).agg(
        F.first("low").alias("low"), F.first("cs").alias("cs"), F.first("tail").alias("tail"),
        (F.max(F.when(plateau, F.col("t"))) - F.min(F.when(plateau, F.col("t")))).cast("double").alias("plateau_s"),
        F.max(above).alias("above"), F.min(F.struct("i", "t")).alias("head"),
        F.max(F.when(F.col("i") >= F.col("low.i"), F.col("agl"))).alias("_top"),
        F.max(F.when(upto, F.col("agl"))).alias("_from"),
        F.max(F.when(in_peak, F.col("vrate"))).alias("peak_climb_fpm"),
        F.bool_or(seg & (F.col("agl") < cfg.touchdown_low_ft)).alias("low_seen"),
        F.bool_or(seg & (F.col("agl") < cfg.touchdown_low_ft) & F.col("onground")).alias("on_ground"),
        F.min(F.when(seg & (F.col("agl") < cfg.touchdown_gs_below_ft), F.col("groundspeed"))).alias("low_gs"),
        F.bool_or(
            seg & (F.col("t_next") <= F.col("end")) & (F.col("t_next") - F.col("t") > cfg.touchdown_gap_s)
            & (F.col("agl") < cfg.touchdown_gap_agl_ft)
        ).alias("low_gap"),
    )
    m = m.withColumns({
        "min_agl_ft": F.col("low.agl"), "t_low": F.col("low.t"), "t_climb": F.col("cs.t"),
        "alt_regain_ft": F.col("_top") - F.col("low.agl"),
        "observed_descent_ft": F.when(F.col("low.i") > F.col("head.i"), F.col("_from") - F.col("low.agl")).otherwise(0.0),
        "entry_i": F.coalesce(F.col("above.i") + 1, F.col("head.i")),
        "entry_t": F.coalesce(F.col("above.t_next"), F.col("head.t")),
    })
    level = F.when(F.col("cs.i") > F.col("entry_i"), F.col("cs.t") - F.col("entry_t")).otherwise(F.col("plateau_s"))
    return m.withColumn("level_s", level.cast("double"))


def touchdown(cfg: Approach = APPROACH):
    return F.coalesce(F.col("low_seen"), F.lit(False)) & (
        F.coalesce(F.col("on_ground"), F.lit(False))
        | (F.col("min_agl_ft") <= cfg.touchdown_agl_ft)
        | ((F.col("min_agl_ft") <= cfg.touchdown_plateau_max_ft) & (F.col("plateau_s") >= cfg.touchdown_plateau_min_s))
        | F.coalesce(F.col("low_gs") <= cfg.touchdown_gs_kt, F.lit(False))
        | F.coalesce(F.col("low_gap"), F.lit(False))
    )


def outcome(m: DataFrame, cfg: Approach = APPROACH) -> DataFrame:
    """Decision chain on the measured profile."""
    m = m.withColumn("touchdown", touchdown(cfg))
    truncated = (
        F.lit(cfg.arrivals_only) & ~F.col("touchdown")
        & (F.col("tail.t") - F.col("end") <= cfg.end_truncated_gap_s)
        & F.coalesce(F.col("tail.agl") <= cfg.end_truncated_agl_ft, F.lit(False))
        & F.coalesce(F.col("tail.vrate") < cfg.end_truncated_vrate_fpm, F.lit(True))
    )
    m = m.withColumns({
        "coverage_truncated": truncated,
        "sustained": F.col("t_climb").isNotNull() & (F.col("alt_regain_ft") >= cfg.regain_min_ft),
    })
    up = F.col("sustained")
    return m.withColumn(
        "outcome",
        F.when(F.col("touchdown") & up, "touch_and_go")
        .when(F.col("touchdown") | (F.col("coverage_truncated") & ~up), "full_stop")
        .when(~up | (F.col("observed_descent_ft") < cfg.min_observed_descent_ft), "unresolved")
        .when(F.col("min_agl_ft") > cfg.max_low_agl_ft, "high_breakoff")
        .when(F.col("level_s") <= cfg.level_go_around_max_s, "go_around")
        .when(F.col("level_s") >= cfg.level_low_approach_min_s, "low_approach")
        .otherwise("ga_ambiguous"),
    )


def reveal_hidden(rows: DataFrame, apps: DataFrame, cfg: Approach = APPROACH) -> DataFrame:
    """Turn climb-aways into go-arounds when the level part was mostly a report gap."""
    level = apps.filter(F.col("outcome").isin("low_approach", "ga_ambiguous")).select(
        *APP, (F.col("t_climb") - F.col("level_s").cast("bigint")).alias("_e"), F.col("t_climb").alias("_c"))
    steps = rows.select(*LEG, "t", "t_next").filter(F.col("t_next") - F.col("t") > cfg.hidden_gap_min_s)
    hit = interval_join(steps, level, keys=LEG, lo="_e", hi="_c")
    part = F.least("t_next", "_c") - F.greatest("t", "_e")
    hidden = hit.groupBy(*APP).agg(F.sum(F.when(part > cfg.hidden_gap_min_s, part)).alias("_h"))
    out = apps.join(hidden, APP, "left").withColumn("low_point_hidden_s", F.coalesce(F.col("_h"), F.lit(0)).cast("double"))
    change = (F.col("low_point_hidden_s") > 0) & (F.col("level_s") - F.col("low_point_hidden_s") <= cfg.level_go_around_max_s)
    return out.withColumns({
        "reclassified_from": F.when(change, F.col("outcome")).otherwise(""),
        "outcome": F.when(change, "go_around").otherwise(F.col("outcome")),
    }).drop("_h")


def chain(apps: DataFrame, cfg: Approach = APPROACH) -> DataFrame:
    """What followed each approach on its leg; short unresolved pieces are continued approaches."""
    w = W.partitionBy(*LEG).orderBy("start")
    gap = F.lead("start").over(w) - F.col("end")
    out = apps.withColumn("next_gap_s", gap.cast("double"))
    joined = (F.col("outcome") == "unresolved") & (F.col("next_gap_s") <= cfg.continued_gap_s)
    return out.withColumns({
        "next_action": F.when(F.col("next_gap_s").isNull(), "leg_end").otherwise("reapproach"),
        "outcome": F.when(F.coalesce(joined, F.lit(False)), "continued_approach").otherwise(F.col("outcome")),
    })


def classify(rows: DataFrame, runways, cfg: Approach = APPROACH) -> DataFrame:
    """Approaches of all legs with outcome, metrics and successor."""
    rows = rows.join(
        rows.groupBy(*LEG).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= cfg.min_leg_points).select(*LEG), LEG, "left_semi")
    rows = with_row_index(rows)
    spans = detect_approaches(rows, runways, cfg)
    if cfg.arrivals_only:
        spans = spans.unionByName(truncated_finals(rows, spans, runways, cfg))
    apps = reveal_hidden(rows, outcome(measure(rows, spans, cfg), cfg), cfg)
    return chain(apps, cfg)


def approach_table(apps: DataFrame, runways, airport) -> DataFrame:
    """Published approach columns with their rounding and local time."""
    dist = None
    for name, tx, ty, bearing in runways:
        along, _ = geo.runway_frame(F.col("cs.x") - tx, F.col("cs.y") - ty, bearing)
        hit = F.col("runway") == name
        dist = F.when(hit, along) if dist is None else dist.when(hit, along)
    lat, lon = geo.unproject(F.col("low.x"), F.col("low.y"), airport.latitude, airport.longitude)
    ts = F.timestamp_seconds
    return apps.select(
        *LEG, "icao24", "runway", ts("start").alias("approach_start_utc"), ts("end").alias("approach_end_utc"),
        "outcome", "touchdown", "coverage_truncated", F.bround("min_agl_ft", 1).alias("min_agl_ft"),
        ts("t_low").alias("t_low_utc"), F.bround(lat, 6).alias("lat_low"), F.bround(lon, 6).alias("lon_low"),
        F.bround("level_s", 1).alias("level_low_duration_s"), ts("t_climb").alias("climb_start_utc"),
        F.bround("cs.agl", 1).alias("init_agl_ft"), F.bround(dist, 3).alias("init_dist_thr_nm"),
        F.bround("peak_climb_fpm", 0).alias("peak_climb_fpm"), F.bround("alt_regain_ft", 1).alias("alt_regain_ft"),
        "next_action", "next_gap_s", F.from_utc_timestamp(ts("t_low"), airport.timezone).alias("t_local"),
        "reclassified_from", "low_point_hidden_s",
    )


MEASURED = ("plateau_band_ft", "climb_vrate_fpm")
COUNTED = ("go_around", "ga_ambiguous", "low_approach", "touch_and_go")


def threshold_grid(rows: DataFrame, spans: DataFrame, grid: dict, cfg: Approach = APPROACH) -> DataFrame:
    """Outcome counts under each one-at-a-time threshold value.

    Thresholds that only enter the decision are all evaluated on one measured
    profile table in one aggregate; only those that change the profile itself
    are measured again.
    """
    def counts(variants, base):
        m = measure(rows, spans, base)
        per = []
        for i, (name, value, first) in enumerate(variants):
            one = outcome(m, dc.replace(base, **{name: value}))
            m = one.withColumnRenamed("outcome", f"_o{i}").drop("touchdown", "coverage_truncated", "sustained")
            per.append(F.struct(
                F.lit(name).alias("param"), F.lit(float(value)).alias("value"), F.lit(value == first).alias("baseline"),
                F.count(F.lit(1)).alias("approaches"),
                *[F.count_if(F.col(f"_o{i}") == o).alias(o) for o in COUNTED]))
        return m.agg(F.array(*per).alias("v")).select(F.explode("v").alias("v")).select("v.*")

    decided = [(n, v, vs[0]) for n, vs in grid.items() if n not in MEASURED for v in vs]
    out = counts(decided, cfg)
    for n in MEASURED:
        for v in grid.get(n, ()):
            out = out.unionByName(counts([(n, v, grid[n][0])], dc.replace(cfg, **{n: v})))
    return out.withColumn("ga_total", F.col("go_around") + F.col("ga_ambiguous"))
