"""Flagged pair-seconds to encounter episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import geo
from ..settings import ENCOUNTER, PROCEDURAL_CLASSES, Airport, Encounter, Spec
from .pairs import evaluate_tiers, within_volume

POINT = ("xa", "ya", "ha", "xb", "yb", "hb", "tra", "trb", "pha", "phb", "zref", "ia", "ib")


def by_kind(ev: DataFrame) -> DataFrame:
    """One row per kind a pair-second belongs to, with the separation that kind uses.

    "any" is the union; it measures the step minimum where the pair is inside
    and the closest approach where it is only predicted to enter.
    """
    step = [F.col("s_step"), F.col("d_step"), F.col("z_step")]
    cpa = [F.col("s_cpa"), F.col("d_cpa"), F.col("z_cpa")]

    def entry(kind, vals, t_entry):
        s, d, z = vals
        return F.struct(F.lit(kind).alias("kind"), s.alias("s"), d.alias("d_h"), z.alias("dz_at"),
                        t_entry.cast("double").alias("t_entry_s"))

    none = F.lit(None)
    inside = F.array(entry("observed", step, none), entry("any", step, none))
    ahead = F.array(entry("predicted", cpa, F.col("t_entry")), entry("any", cpa, none))
    keep = [c for c in ev.columns if c not in (
        "s_step", "d_step", "z_step", "s_cpa", "d_cpa", "z_cpa", "t_entry", "s_now", "observed", "predicted", "t_cpa")]
    return (
        ev.withColumn("_k", F.explode(F.when(F.col("observed"), inside).when(F.col("predicted"), ahead)))
        .select(*keep, "_k.*")
    )


def episodes(flagged: DataFrame, runways, ceiling_ft, *, keys=("day",), merge_gap_s=ENCOUNTER.merge_gap_s) -> DataFrame:
    """Merge flagged seconds of a pair, tier and kind into episodes.

    A step above merge_gap + 1 seconds starts a new episode; the episode is
    described at its smallest separation (ties: smaller distance, then earlier).
    ``keys`` may include a variant id, so one pass serves many settings.
    """
    group = [*keys, "a", "b", "tier", "kind"]
    w = W.partitionBy(*group).orderBy("t")
    gap = F.col("t") - F.lag("t").over(w)
    ep = flagged.withColumn("_new", F.coalesce(gap > merge_gap_s + 1, F.lit(True)).cast("int")).withColumn(
        "ep", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    # equal separations are common on straight courses, so rounding noise must not decide
    rank = F.struct(F.round(F.col("s") + 1e-6 * F.col("d_h") / F.col("h_lim"), 9).alias("k"), F.col("t"))
    point = F.struct(F.col("t").alias("t_min"), F.col("d_h"), F.col("dz_at"), F.col("s"), F.col("t_entry_s"),
                     *[F.col(c) for c in POINT])
    out = ep.groupBy(*group, "ep").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min_by(point, rank).alias("m")
    )
    out = out.select(*group, "t_start", "t_end", (F.col("t_end") - F.col("t_start") + 1).alias("duration_s"), "m.*")
    ceiling = ceiling_ft if not isinstance(ceiling_ft, (int, float)) else F.lit(float(ceiling_ft))
    out = geo.with_geometry_class(out, runways).withColumns({
        "phase_a": geo.phase_label(F.col("pha"), runways), "phase_b": geo.phase_label(F.col("phb"), runways),
        "h_max_ft": F.greatest("ha", "hb"),
    })
    return out.select(
        *group, "t_start", "t_end", "duration_s", "t_min", F.col("d_h").alias("d_h_min_nm"),
        F.col("dz_at").alias("dz_at_min_ft"), F.col("s").alias("s_min"), "t_entry_s",
        "xa", "ya", "ha", "xb", "yb", "hb", "h_max_ft", (F.col("h_max_ft") <= ceiling).alias("inside_ceiling"),
        F.when(F.col("zref") == 1, "baro").otherwise("geo").alias("zref"),
        "phase_a", "phase_b", "geometry_class", (F.col("ia") | F.col("ib")).alias("interpolated"),
    )


def encounters(pairs: DataFrame, spec: Spec, runways, *, keys=("day",), cfg: Encounter = ENCOUNTER) -> DataFrame:
    """All episodes of every tier and kind in the extended volume, in one pass."""
    inside = within_volume(pairs, spec.radius_nm, spec.extended_ceiling_ft)
    flagged = by_kind(evaluate_tiers(inside, spec, cfg))
    out = episodes(flagged, runways, spec.ceiling_ft, keys=keys, merge_gap_s=spec.merge_gap_s)
    if spec.exclude_procedural:
        out = out.filter(~F.col("geometry_class").isin(*PROCEDURAL_CLASSES))
    return out


def with_identity(enc: DataFrame, legs: DataFrame, airport: Airport, *, keys=("day",)) -> DataFrame:
    """Aircraft identity of both sides and latitude/longitude of the closest point."""
    for side in ("a", "b"):
        ident = legs.select(
            *keys, F.col("leg").alias(side),
            *[F.col(c).alias(f"{c}_{side}") for c in ("icao24", "callsign", "leg_id") if c in legs.columns],
        )
        lat, lon = geo.unproject(F.col(f"x{side}"), F.col(f"y{side}"), airport.latitude, airport.longitude)
        enc = enc.join(ident, [*keys, side], "left").withColumns({f"lat_{side}": lat, f"lon_{side}": lon})
    return enc
