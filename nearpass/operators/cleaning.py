"""Raw position reports to clean flight legs.

The chain keeps one partitioning, (day, icao24): de-duplication, freshness,
leg splitting, per-leg medians and smoothing are all windows on it, so the
reports are shuffled once. A (day, icao24) group holds at most one row per
second of a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geo
from ..functions.timefns import day_text
from ..settings import CLEANING, DAY_S, Airport, Cleaning
from .intervals import interval_join

TRACK = ("day", "icao24")


def _track_window(keys=TRACK):
    return W.partitionBy(*keys)


def bounding_box(df: DataFrame, airport: Airport, radius_nm: float) -> DataFrame:
    """Latitude/longitude limits around the airport that reach the Parquet scan."""
    import math

    dlat = radius_nm / 60.0 * 1.02
    dlon = dlat / max(0.05, math.cos(math.radians(abs(airport.latitude) + dlat)))
    return df.filter(
        F.col("latitude").between(airport.latitude - dlat, airport.latitude + dlat)
        & F.col("longitude").between(airport.longitude - dlon, airport.longitude + dlon)
    )


def floor_to_second(df: DataFrame, keys=TRACK) -> DataFrame:
    """Whole-second time ``t``; the first report of each aircraft-second is kept."""
    w = _track_window(keys).orderBy("timestamp")
    return (
        df.withColumn("t", F.unix_seconds("timestamp"))
        .withColumn("_p", F.lag("t").over(w))
        .filter(~F.col("t").eqNullSafe(F.col("_p")))
        .drop("_p")
    )


def with_plane(df: DataFrame, airport: Airport) -> DataFrame:
    x, y = geo.project(F.col("latitude"), F.col("longitude"), airport.latitude, airport.longitude)
    return df.withColumns({"x": x, "y": y})


def within_radius(df: DataFrame, airport: Airport, cfg: Cleaning = CLEANING) -> DataFrame:
    """Reports within the load radius, with plane coordinates x and y (NM)."""
    near = with_plane(bounding_box(df, airport, cfg.load_radius_nm), airport)
    return near.filter(F.hypot("x", "y") <= cfg.load_radius_nm)


def fresh_reports(df: DataFrame, cfg: Cleaning = CLEANING, keys=TRACK) -> DataFrame:
    """Rows that carry a new position report, re-timed to the report time.

    A row with unknown position time stays as it is. The previous row is the
    previous row of the aircraft, kept or not.
    """
    pt = F.col("position_time")
    age = F.unix_micros("timestamp") / 1e6 - pt
    prev = F.lag("position_time").over(_track_window(keys).orderBy("timestamp"))
    kept = (
        df.withColumn("_new", ~pt.eqNullSafe(prev))
        .filter(pt.isNull() | (F.col("_new") & (F.abs(age) <= cfg.max_position_age_s)))
        .withColumn("_old", F.col("timestamp"))
        .withColumn(
            "timestamp",
            F.when(pt.isNull(), F.col("timestamp")).otherwise(F.timestamp_seconds(F.bround(pt).cast("bigint"))),
        )
    )
    w = _track_window(keys).orderBy("timestamp", "_old")
    return (
        kept.withColumn("_p", F.lag("timestamp").over(w))
        .filter(~F.col("timestamp").eqNullSafe(F.col("_p")))
        .drop("_p", "_new", "_old")
    )


def _kept_places(rows: str, max_speed: float) -> Column:
    """Places of the fixes that a walk along the array keeps; a fix is kept if the last kept one can reach it.

    The walk remembers its decisions as bits, 64 in a word, so that its state stays small however long the array.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("i"), zero.alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), zero.alias("word"), F.array().cast("array<bigint>").alias("words"))

    def step(at, fix):
        dt = fix["t"] - at["t"]
        keep = (at["i"] == 0) | ((dt > 0) & (F.hypot(fix["x"] - at["x"], fix["y"] - at["y"]) * 3600.0 <= max_speed * dt))
        place = F.pmod(at["i"], F.lit(64))
        word = at["word"].bitwiseOR(F.when(keep, F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(0))
        full = place == 63
        last = {c: F.when(keep, fix[c]).otherwise(at[c]).alias(c) for c in ("t", "x", "y")}
        return F.struct((at["i"] + 1).alias("i"), last["t"], last["x"], last["y"], F.when(full, zero).otherwise(word).alias("word"),
                        F.when(full, F.concat(at["words"], F.array(word))).otherwise(at["words"]).alias("words"))

    words = F.aggregate(rows, start, step, lambda at: F.concat(at["words"], F.array(at["word"])))
    bit = lambda w, j: F.call_function("shiftright", w, F.pmod(j, F.lit(64))).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.flatten(F.transform(words, lambda w, k: F.filter(F.sequence(k * 64, k * 64 + 63), lambda j: bit(w, j))))


def drop_jumps(df: DataFrame, cfg: Cleaning = CLEANING, keys=TRACK) -> DataFrame:
    """Drop fixes that cannot be reached from the last kept fix.

    "Last kept" depends on all earlier decisions, which no window function can
    state: the fixes of an aircraft-day, one per second at most, are folded in
    order. The rows come out in the partitioning they came in.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in (*keys, "t")]
    track = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", *rest))).alias("_rows"))
    kept = F.transform(_kept_places("_rows", float(cfg.max_speed_kt)), lambda j: F.get("_rows", j))
    return track.select(*keys, F.explode(kept).alias("_row")).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def split_legs(df: DataFrame, cfg: Cleaning = CLEANING, keys=TRACK, min_points: int | None = None) -> DataFrame:
    """Leg number per aircraft-day (new leg after a silence); short legs are dropped."""
    keys = list(keys)
    w = _track_window(keys).orderBy("t")
    gap = F.col("t") - F.lag("t").over(w)
    legs = df.withColumn("_new", (F.coalesce(gap, F.lit(0)) > cfg.leg_gap_s).cast("int")).withColumn(
        "leg_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    n = F.count(F.lit(1)).over(W.partitionBy(*keys, "leg_no"))
    return (
        legs.withColumn("_n", n)
        .filter(F.col("_n") >= (cfg.min_points if min_points is None else min_points))
        .drop("_new", "_n")
    )


def leg_keys(keys=TRACK) -> list:
    return [*keys, "leg_no"]


def smooth(col: str, half: int, keys) -> Column:
    """Centred rolling median over 2*half+1 rows of a leg, nulls skipped."""
    return F.percentile(F.col(col), F.lit(0.5)).over(W.partitionBy(*keys).orderBy("t").rowsBetween(-half, half))


def leg_median(col: Column, keys) -> Column:
    return F.percentile(col, F.lit(0.5)).over(W.partitionBy(*keys))


def drop_geo_spikes(df: DataFrame, cfg: Cleaning = CLEANING, keys=TRACK) -> DataFrame:
    """Geometric altitude far from the leg's usual offset to barometric becomes null."""
    off = F.col("geoaltitude") - F.col("altitude")
    return (
        df.withColumn("_m", leg_median(off, leg_keys(keys)))
        .withColumn(
            "geoaltitude",
            F.when(F.coalesce(F.abs(off - F.col("_m")) > cfg.geo_baro_max_dev_ft, F.lit(False)), F.lit(None))
            .otherwise(F.col("geoaltitude")),
        )
        .drop("_m")
    )


def height_above_field(df: DataFrame, elevation_ft: float, keys=TRACK) -> DataFrame:
    """Height ``h`` from geometric altitude, else re-referenced barometric altitude."""
    lk = leg_keys(keys)
    off = leg_median(F.col("geoaltitude") - F.col("altitude"), lk)
    known = F.count("geoaltitude").over(W.partitionBy(*lk))
    out = df.withColumns({"_off": off, "_known": known})
    baro = F.col("altitude") - elevation_ft
    h = F.when(F.col("_known") == 0, baro).otherwise(
        F.coalesce(F.col("geoaltitude") - elevation_ft, baro + F.col("_off"))
    )
    return out.withColumns({"h": h, "geo_missing": F.col("_known") == 0}).drop("_off", "_known")


def approach_height(df: DataFrame, ground: Column, half: int = 3, keys=TRACK) -> DataFrame:
    """Smoothed height above ground ``agl`` with the smoothed barometric fallback."""
    lk = leg_keys(keys)
    out = df.withColumns({
        "_g": F.col("geoaltitude") - ground,
        "_off": leg_median(F.col("geoaltitude") - F.col("altitude"), lk),
    })
    out = out.withColumn("_b", F.col("altitude") + F.col("_off") - ground)
    return out.withColumn("agl", F.coalesce(smooth("_g", half, lk), smooth("_b", half, lk))).drop("_g", "_b", "_off")


def leg_id(icao24: Column, t_first: Column) -> Column:
    return F.concat_ws("_", icao24, F.date_format(F.timestamp_seconds(t_first), "yyyyMMdd_HHmmss"))


def leg_table(df: DataFrame, keys=TRACK) -> DataFrame:
    """One row per leg: identity, time range, number of reports."""
    lk = leg_keys(keys)
    legs = df.groupBy(*lk).agg(
        F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count(F.lit(1)).alias("n_raw"),
        F.coalesce(F.trim(F.mode("callsign", True)), F.lit("")).alias("callsign"),
        F.bool_and(F.col("geo_missing")).alias("geo_missing"),
    )
    return legs.withColumn("leg_id", leg_id(F.col("icao24"), F.col("t_first")))


def clean_reports(df: DataFrame, airport: Airport, cfg: Cleaning = CLEANING) -> DataFrame:
    """Reports to clean legs with height ``h`` and smoothed ``vrate``."""
    out = fresh_reports(df, cfg) if "position_time" in df.columns else df
    out = within_radius(floor_to_second(out), airport, cfg)
    out = split_legs(drop_jumps(out, cfg), cfg)
    out = height_above_field(drop_geo_spikes(out, cfg), airport.elevation_ft)
    return out.withColumn("vrate", smooth("vertical_rate", cfg.smooth_half_rows, leg_keys()))


# ------------------------------------------------------------- per day ----

def file_day(df: DataFrame, key: str = "day") -> DataFrame:
    """UTC date holding the middle report of each daily file.

    Reports are counted per date first; the middle one lies in the first date
    whose running count passes half of the file.
    """
    per = df.groupBy(key, day_text(F.unix_seconds("timestamp")).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key)
    run = per.withColumns({
        "_c": F.sum("n").over(w.orderBy("date").rowsBetween(W.unboundedPreceding, 0)),
        "_n": F.sum("n").over(w),
    })
    hit = run.filter(F.col("_c") > F.floor(F.col("_n") / 2))
    return hit.groupBy(key).agg(F.min("date").alias("date"))


def messages_per_second(df: DataFrame, keys=("day",)) -> DataFrame:
    """Raw message count per second of the day."""
    sec = F.unix_seconds("timestamp") % DAY_S
    return df.groupBy(*keys, sec.alias("sec")).agg(F.count(F.lit(1)).alias("n"))


def outages(df: DataFrame, legs: DataFrame, cfg: Cleaning = CLEANING, keys=("day",)) -> DataFrame:
    """Silences longer than a minute that at least one leg flies through."""
    keys = list(keys)
    heard = df.select(*keys, F.unix_seconds("timestamp").alias("t")).distinct()
    gaps = (
        heard.withColumn("a", F.lag("t").over(W.partitionBy(*keys).orderBy("t")))
        .filter(F.col("t") - F.col("a") > cfg.outage_min_s)
        .select(*keys, "a", F.col("t").alias("b"))
    )
    return interval_join(
        gaps, legs.select(*keys, "t_first", "t_last"), keys=keys, t="a", lo="t_first", hi="t_last", bin_s=3600,
        how="left_semi",
        extra=lambda p, s: (F.col(f"{s}.t_first") < F.col(f"{p}.a")) & (F.col(f"{s}.t_last") > F.col(f"{p}.b")),
    )
