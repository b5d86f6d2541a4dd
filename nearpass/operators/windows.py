"""Windows, their counts, covariates and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timefns
from ..functions.geo import phase_runway
from ..settings import DAY_S, DEPARTURE_BASE, GEOMETRY_CLASSES, KINDS, PROCEDURAL_CLASSES, WINDOWS, Spec, Windows
from . import exposure as ex
from .intervals import interval_join, interval_sums


def clock_windows(days: DataFrame, minutes: int, keys=()) -> DataFrame:
    """Every window of every day, empty ones included. ``days`` holds day, day_no."""
    w = minutes * 60
    k = F.explode(F.sequence(F.lit(0), F.lit(DAY_S // w - 1))).alias("k")
    start = F.col("day_no") * DAY_S + F.col("k") * w
    return days.select(*keys, "day", "day_no", k).select(
        *keys, F.concat_ws("_", "day", F.lpad(F.col("k").cast("string"), 3, "0")).alias("window_id"), "day",
        start.alias("t_start"), (start + w).alias("t_end"),
    )


# --------------------------------------------------------------- counts ----

def count_columns(tiers) -> dict:
    """Column name to condition on (tier, kind, geometry_class)."""
    tier, kind, cls = F.col("tier"), F.col("kind"), F.col("geometry_class")
    cols = {}
    for name in tiers:
        for k in KINDS:
            cols[f"{name}_{k}"] = (tier == name) & (kind == k)
        for c in GEOMETRY_CLASSES:
            cols[f"{name}_any_{c}"] = (tier == name) & (kind == "any") & (cls == c)
        cols[f"{name}_any_nonprocedural"] = (tier == name) & (kind == "any") & ~cls.isin(*PROCEDURAL_CLASSES)
    return cols


def encounter_counts(enc: DataFrame, spans: DataFrame, tiers, *, ids=("window_id",), keys=()) -> DataFrame:
    """Encounters inside the nominal ceiling per span, by the time of minimum.

    Encounters are first counted per second, so the interval step handles one
    row per second whatever the traffic.
    """
    cols = count_columns(tiers)
    per = enc.filter("inside_ceiling").groupBy(*keys, F.col("t_min").alias("t")).agg(
        *[F.count_if(c).alias(n) for n, c in cols.items()])
    return interval_sums(per, spans, list(cols), keys=keys, ids=ids)


def span_minimum(flagged: DataFrame, spans: DataFrame, *, ids=("window_id",), keys=(), bin_s: int = 600) -> DataFrame:
    """Smallest normalised separation of any flagged pair-second in each span."""
    per = flagged.groupBy(*keys, "t").agg(F.min("s_step").alias("s"))
    hit = interval_join(per, spans.select(*keys, *ids, "t_start", "t_end"), keys=keys, bin_s=bin_s)
    return hit.groupBy(*ids).agg(F.min("s").alias("s_min"))


# ---------------------------------------------------------------- flows ----

def runway_usage(approaches: DataFrame, presence: DataFrame, runways, flow, *, keys=("day",)) -> DataFrame:
    """Arrivals at their low point and departures at the first departure second of a leg."""
    names = [r[0] for r in runways]
    arr = approaches.filter(F.col("runway").isin(*names)).select(
        F.col("t_low").alias("t"), "runway", F.lit("arrival").alias("kind"))
    dep = (
        presence.filter(F.col("phase") > DEPARTURE_BASE)
        .groupBy(*keys, "leg").agg(F.min_by("phase", "t").alias("phase"), F.min("t").alias("t"))
        .select("t", phase_runway(F.col("phase"), runways).alias("runway"), F.lit("departure").alias("kind"))
    )
    return arr.unionByName(dep).withColumn("flow", flow(F.col("runway")))


def flow_labels(centres: DataFrame, usage: DataFrame, *, ids=("window_id",), keys=(), cfg: Windows = WINDOWS) -> DataFrame:
    """Dominant flow in the hour around each centre, else 'mixed'; 'none' without use.

    ``centres`` holds the ids and ``centre`` (whole or half seconds). Uses are
    counted per (time, flow) before the interval join.
    """
    use = usage.groupBy(*keys, "t", "flow").agg(F.count(F.lit(1)).alias("n"))
    spans = centres.select(
        *keys, *ids, F.ceil(F.col("centre") - cfg.flow_half_s).alias("t_start"),
        F.ceil(F.col("centre") + cfg.flow_half_s).alias("t_end"),
    )
    hit = interval_join(use, spans, keys=keys, bin_s=1800)
    per = hit.groupBy(*ids, "flow").agg(F.sum("n").alias("n"))
    # largest count, the alphabetically first flow on ties
    best = per.groupBy(*ids).agg(
        F.min_by("flow", F.struct(-F.col("n"), F.col("flow"))).alias("top"),
        (F.max("n") / F.sum("n")).alias("share"),
    )
    label = F.when(F.col("top").isNull(), "none").when(F.col("share") >= cfg.flow_share, F.col("top")).otherwise("mixed")
    return centres.select(*ids).join(best, list(ids), "left").select(*ids, label.alias("flow"))


# -------------------------------------------------------------- quality ----

def quality_class(interp: Column, gaps_per_aircraft: Column, outage: Column, cfg: Windows = WINDOWS) -> Column:
    return (
        F.when((interp > cfg.bad_interp) | (gaps_per_aircraft > cfg.bad_gaps) | outage, "bad")
        .when((interp > cfg.degraded_interp) | (gaps_per_aircraft > cfg.degraded_gaps), "degraded")
        .otherwise("good")
    )


def covariates(spans: DataFrame, tz: str) -> DataFrame:
    t = F.col("t_start")
    return spans.withColumns({
        "local_hour": timefns.local_hour(t, tz), "daytype": timefns.daytype(t, tz), "month": timefns.month_utc(t),
    })


def interval_metrics(
    spans: DataFrame, *, presence: DataFrame, gaps: DataFrame, outages: DataFrame, days: DataFrame, usage: DataFrame,
    enc: DataFrame, spec: Spec, tz: str, flagged: DataFrame | None = None, ids=("window_id",), keys=(),
    cfg: Windows = WINDOWS,
) -> DataFrame:
    """Every metric of each span: exposure, quality, covariates, flow, counts, rates.

    Each part is aggregated to one row per span before the joins on the span
    ids, so the final joins are small. ``flagged`` (T1 pair-seconds with
    s_step) adds the closest separation.
    """
    ids = list(ids)
    tiers = [t[0] for t in spec.tiers]
    parts = [
        ex.span_exposure(presence, spans, spec, ids=ids, keys=keys),
        ex.distinct_aircraft(ex.presence_runs(presence, spec, keys=keys), spans, ids=ids, keys=keys),
        ex.gap_counts(ex.gaps_in_volume(gaps, presence, spec, **({"keys": keys} if keys else {})), spans, ids=ids, keys=keys),
        ex.outage_flags(outages, spans, ids=ids, keys=keys),
        ex.covered_seconds(spans, days, ids=ids, keys=keys),
        encounter_counts(enc, spans, tiers, ids=ids, keys=keys),
        flow_labels(spans.withColumn("centre", (F.col("t_start") + F.col("t_end")) / 2), usage, ids=ids, keys=keys, cfg=cfg),
    ]
    if flagged is not None:
        parts.append(span_minimum(flagged, spans, ids=ids, keys=keys))
    out = spans
    for p in parts:
        out = out.join(p, ids, "left")
    zero = [c for c in out.columns if c in ("aircraft_s", "pair_s", "pair_s_inner", "interp_s", "n_aircraft", "gap_count", "covered_s")]
    out = out.fillna(0, zero + list(count_columns(tiers))).fillna(False, ["outage"])
    ac = F.col("aircraft_s")
    out = covariates(out, tz).withColumns({
        "pair_hours": F.col("pair_s") / 3600.0, "pair_hours_inner": F.col("pair_s_inner") / 3600.0,
        "partial_coverage": F.col("covered_s") < F.col("t_end") - F.col("t_start"),
        "interp_fraction": F.coalesce(F.try_divide("interp_s", "aircraft_s"), F.lit(0.0)),
    })
    gpa = F.coalesce(F.try_divide("gap_count", "n_aircraft"), F.lit(0.0))
    out = out.withColumn("quality", quality_class(F.col("interp_fraction"), gpa, F.col("outage"), cfg))
    return out.withColumns({
        f"{t}_any_rate": F.try_divide(F.col(f"{t}_any"), F.col("pair_hours")) for t in tiers
    }).drop("pair_s", "pair_s_inner", "interp_s", "covered_s")


def minute_bins(events: DataFrame, cfg: Windows = WINDOWS, ids=("event_id",)) -> DataFrame:
    """One-minute spans from half an hour before to half an hour after each event."""
    m = F.explode(F.sequence(F.lit(-cfg.epoch_half_min), F.lit(cfg.epoch_half_min - 1))).alias("minute")
    start = F.col("t0") + F.col("minute") * cfg.epoch_step_s
    keep = [c for c in events.columns if c not in ids and c != "t0"]
    return events.select(*ids, "t0", *keep, m).select(
        *ids, *keep, "minute", start.alias("t_start"), (start + cfg.epoch_step_s).alias("t_end"))


def day_quality(windows: DataFrame, keys=("day",)) -> DataFrame:
    """Window quality counts and traffic totals per day."""
    q = F.col("quality")
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(q == "good").alias("good"),
        F.count_if(q == "degraded").alias("degraded"), F.count_if(q == "bad").alias("bad"),
        F.avg("interp_fraction").alias("interp_fraction"), F.sum("gap_count").alias("gaps"),
        F.count_if("outage").alias("outage_windows"), F.sum("pair_hours").alias("pair_hours"),
        F.max("n_aircraft").alias("aircraft_max"),
    )
