"""Data audit per day and detection of profile settings from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geo import flat_distance
from ..functions.plan import cut_lineage
from ..settings import BASELINE, DETECTION, VOLUME, Airport, Detection
from .grid import with_motion
from .quantiles import grouped_quantiles


def audit_days(raw: DataFrame, fresh: DataFrame, near: DataFrame, kept: DataFrame, clean: DataFrame, grid: DataFrame, gaps: DataFrame,
               silences: DataFrame) -> DataFrame:
    """One row per day with row counts, stale share, aircraft, legs (also those airborne in the volume), dropped jumps, gaps, shares of interpolated
    seconds, outages and altitude availability.

    ``near`` are the reports before the jump filter and ``kept`` those after it; ``silences`` the outages (a, b) in seconds.
    Each input is reduced to one row per day before the joins. ``schema_audit`` lists files that cannot be read.
    """
    share = lambda c: F.avg(c.cast("double"))
    a = raw.groupBy("day").agg(F.count(F.lit(1)).alias("rows_in_file"))
    b = fresh.groupBy("day").agg(
        F.count(F.lit(1)).alias("messages"), share(F.col("altitude").isNotNull()).alias("baro_alt_share"),
        share(F.col("geoaltitude").isNotNull()).alias("geo_alt_share"), share(F.col("onground")).alias("onground_share"))
    c = clean.groupBy("day").agg(F.count_distinct("icao24").alias("aircraft"), F.count_distinct("icao24", "leg_no").alias("legs"), F.count(F.lit(1)).alias("clean_rows"))
    leg = F.struct("icao24", "leg_no")
    g = with_motion(grid).groupBy("day").agg(share(F.col("interpolated")).alias("interp_share"), share(F.col("interp_long")).alias("interp_long_share"),
                                             F.count_distinct(F.when(F.col("airborne") & (F.col("r") <= VOLUME.radius_nm), leg)).alias("airborne_in_volume"))
    h = gaps.groupBy("day").agg(F.count(F.lit(1)).alias("gaps_over_10s"))
    j = near.groupBy("day").agg(F.count(F.lit(1)).alias("messages_in_radius"))
    k = kept.groupBy("day").agg(F.count(F.lit(1)).alias("_kept"))
    o = silences.groupBy("day").agg(F.count(F.lit(1)).alias("outages"), F.sum(F.col("b") - F.col("a")).alias("outage_s"))
    out = a
    for p in (b, c, g, h, j, k, o):
        out = out.join(p, "day", "left")
    out = out.fillna(0, ["gaps_over_10s", "messages_in_radius", "_kept", "outages", "outage_s", "airborne_in_volume"])
    out = out.withColumn("dropped_jumps", F.col("messages_in_radius") - F.col("_kept")).drop("_kept").withColumnRenamed("clean_rows", "messages_in_legs")
    return out.withColumn("stale_position_share", 1 - F.col("messages") / F.col("rows_in_file"))


def volume_verdict(days: DataFrame) -> DataFrame:
    """Is there enough data for a baseline?"""
    n = F.count(F.lit(1))
    return days.agg(n.alias("days"), (n >= BASELINE.min_days).alias("meets_minimum"), (n >= BASELINE.recommended_days).alias("meets_recommended"))


def sample_days(days: DataFrame, n: int = DETECTION.max_days) -> DataFrame:
    """At most n days, evenly spread over the dataset."""
    w = W.partitionBy(F.lit(0))  # one row per day
    d = days.withColumns({"_i": F.row_number().over(w.orderBy("day")) - 1, "_n": F.count(F.lit(1)).over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / (n - 1)))
    return d.filter((F.col("_n") <= n) | F.array_contains(picks, F.col("_i").cast("double"))).drop("_i", "_n")


def detect_profile(reports: DataFrame, airport: Airport, cfg: Detection = DETECTION) -> DataFrame:
    """Preset by final-approach speed and landing assumption by ground visibility, one row."""
    t = F.unix_seconds("timestamp")
    h = F.coalesce("geoaltitude", "altitude") - airport.elevation_ft
    p = reports.withColumns({"t": t, "h": h, "d": flat_distance(F.col("latitude"), F.col("longitude"), airport.latitude, airport.longitude)})
    fin = (
        (F.col("d") < cfg.final_radius_nm) & F.col("h").between(*cfg.final_height_ft)
        & (F.col("vertical_rate") <= cfg.final_max_vrate_fpm) & ~F.col("onground"))
    w = W.partitionBy("day", "icao24").orderBy("timestamp")
    p = p.withColumn("_new", F.coalesce(F.col("t") - F.lag("t").over(w) > cfg.leg_gap_s, F.lit(True)).cast("int"))
    p = p.withColumn("leg", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max("t").over(W.partitionBy("day", "icao24", "leg"))
    legs = p.withColumn("_last", last).groupBy("day", "icao24", "leg").agg(
        F.max_by(F.struct("d", "h"), "timestamp").alias("z"),
        F.bool_or(F.col("onground") & (F.col("_last") - F.col("t") <= cfg.end_lookback_s)).alias("ground"))
    low = cut_lineage(legs.filter((F.col("z.d") < cfg.end_radius_nm) & (F.col("z.h") < cfg.end_height_ft)).select(F.col("z.h").alias("end_height"), "ground"))
    final = cut_lineage(p.filter(fin).select("groundspeed"))
    share = low.agg(F.count(F.lit(1)).alias("legs_ending_low"), F.avg(F.col("ground").cast("double")).alias("ground_visible_share"))
    height = grouped_quantiles(low, ["end_height"], [cfg.floor_percentile]).select(F.get("end_height", F.lit(0)).alias("end_height_p_ft"))
    speed = grouped_quantiles(final, ["groundspeed"], [0.5]).select(
        F.coalesce("n_groundspeed", F.lit(0).cast("long")).alias("final_samples"), F.get("groundspeed", F.lit(0)).alias("final_gs_median_kt"))
    out = speed.crossJoin(F.broadcast(share)).crossJoin(F.broadcast(height))  # one row each
    return out.withColumns({
        "preset": F.when(F.col("final_samples") >= cfg.min_samples,
                         F.when(F.col("final_gs_median_kt") >= cfg.air_carrier_gs_kt, "air_carrier").otherwise("training_ga")),
        "arrivals_only": F.when(F.col("legs_ending_low") >= cfg.min_legs, F.col("ground_visible_share") < cfg.ground_share),
        "coverage_floor_ft": F.least(F.lit(cfg.floor_cap_ft), F.ceil((F.col("end_height_p_ft") + cfg.floor_margin_ft) / 50) * 50),
    })
