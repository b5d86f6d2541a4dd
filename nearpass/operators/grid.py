"""Clean legs to one row per aircraft-second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..settings import CLEANING, Cleaning
from .cleaning import TRACK, leg_keys

KNOWN = {"z_baro": "altitude", "z_geo": "geoaltitude", "h": "h", "gs": "groundspeed", "vrate": "vrate"}


def _with_neighbours(df: DataFrame, values: dict, lk) -> DataFrame:
    """Nearest known (time, value) at or before each fix and after it, per column.

    The look-ahead is a second window in descending order, which stays linear
    in the length of a leg.
    """
    back = W.partitionBy(*lk).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*lk).orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, -1)
    both = {}
    for name, col in values.items():
        known = F.when(col.isNotNull(), F.struct(F.col("t").alias("t"), col.cast("double").alias("v")))
        both[f"_p_{name}"] = F.last(known, ignorenulls=True).over(back)
        both[f"_n_{name}"] = F.last(known, ignorenulls=True).over(ahead)
    return df.withColumns(both)


def _between(name: str, t: Column) -> Column:
    p, n = F.col(f"_p_{name}"), F.col(f"_n_{name}")
    frac = (t - p["t"]) / (n["t"] - p["t"])
    return F.when(p["t"] == t, p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * frac)


def leg_to_grid(df: DataFrame, cfg: Cleaning = CLEANING, keys=TRACK) -> DataFrame:
    """Every second of each leg except those strictly inside a long report gap.

    Positions run linearly between fixes; the other columns run between their
    nearest known values and stay null outside them; the heading runs through
    its sine and cosine.
    """
    lk = leg_keys(keys)
    rad = F.radians("track")
    values = {name: F.col(col) for name, col in KNOWN.items()}
    values |= {
        "x": F.col("x"), "y": F.col("y"), "sin": F.sin(rad), "cos": F.cos(rad),
        "ground": F.col("onground").cast("double"),
    }
    w = W.partitionBy(*lk).orderBy("t")
    fixes = _with_neighbours(df, values, lk).withColumn("_t2", F.lead("t").over(w))
    step = F.col("_t2") - F.col("t")
    seconds = F.when(step <= cfg.max_interp_gap_s, F.sequence(F.col("t"), F.col("_t2") - 1)).otherwise(
        F.array(F.col("t"))
    )
    keep = [*lk, F.col("t").alias("_t1"), step.alias("_gap")] + [
        F.col(f"_{s}_{n}") for n in values for s in ("p", "n")
    ]
    rows = fixes.select(*keep, F.explode(seconds).alias("t"))
    t = F.col("t")
    filled = t > F.col("_t1")
    out = rows.select(
        *lk, "t", *[_between(n, t).alias(n) for n in ("x", "y", *KNOWN)],
        F.pmod(F.degrees(F.atan2(_between("sin", t), _between("cos", t))), F.lit(360.0)).alias("track"),
        (_between("ground", t) > 0.5).alias("onground"),
        filled.alias("interpolated"),
        (filled & (F.col("_gap") > cfg.long_interp_gap_s)).alias("interp_long"),
    )
    return out


def with_motion(grid: DataFrame, cfg: Cleaning = CLEANING) -> DataFrame:
    """Velocity in the plane (NM/s, ft/s), distance from the airport, airborne flag."""
    b, v = F.radians("track"), F.col("gs") / 3600.0
    return grid.withColumns({
        "vx": v * F.sin(b), "vy": v * F.cos(b), "vz": F.col("vrate") / 60.0, "r": F.hypot("x", "y"),
        "airborne": F.coalesce(
            ~F.col("onground") & (F.col("gs") >= cfg.airborne_min_gs_kt) & F.col("h").isNotNull(), F.lit(False)
        ),
    })


def report_gaps(df: DataFrame, cfg: Cleaning = CLEANING, keys=TRACK) -> DataFrame:
    """Report gaps of a leg that are too long to fill."""
    lk = leg_keys(keys)
    t2 = F.lead("t").over(W.partitionBy(*lk).orderBy("t"))
    return (
        df.select(*lk, F.col("t").alias("t_start"), t2.alias("t_end"))
        .filter(F.col("t_end") - F.col("t_start") > cfg.max_interp_gap_s)
        .withColumn("gap_s", F.col("t_end") - F.col("t_start"))
    )
