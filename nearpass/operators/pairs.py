"""Aircraft pairs of the same second and the zones they enter."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, zones
from ..functions.plan import pin
from ..settings import ENCOUNTER, Encounter, Spec

SIDE = ("leg", "x", "y", "z_baro", "z_geo", "h", "r", "vx", "vy", "vz", "track", "phase", "interpolated")
STATE = ("rx", "ry", "vx", "vy", "dz", "vz")


def presence(grid: DataFrame, runways, ceiling_ft: float, keys=("day",)) -> DataFrame:
    """Airborne aircraft-seconds below the computation ceiling, with flight phase."""
    air = grid.filter(F.col("airborne") & (F.col("h") <= ceiling_ft))
    return geo.with_phase(air, runways)


def with_presence(grid: DataFrame, runways, ceiling_ft: float) -> DataFrame:
    """All rows of the grid, with the flight phase of those that are in ``presence`` and null for the others."""
    return geo.with_phase(grid, runways).withColumn("phase", F.when(F.col("airborne") & (F.col("h") <= ceiling_ft), F.col("phase")))


def crowded_seconds(rows: DataFrame, keys, limit: int) -> DataFrame:
    """Keys with more rows than ``limit`` and the number of parts to cut them into."""
    return (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    )


def _sides(a: DataFrame, b: DataFrame, keys, extra_keys=()):
    left = a.select(*keys, *extra_keys, *[F.col(c).alias(f"{c}_a") for c in SIDE])
    right = b.select(*[F.col(k).alias(f"_{k}") for k in (*keys, *extra_keys)], *[F.col(c).alias(f"{c}_b") for c in SIDE])
    on = F.col("leg_a") < F.col("leg_b")
    for k in (*keys, *extra_keys):
        on &= F.col(k) == F.col(f"_{k}")
    return left, right, on


def relative_state():
    """Relative position, velocity and height difference of the joined sides.

    Height uses barometric altitude when both aircraft report it, else
    geometric altitude for both.
    """
    both = F.col("z_baro_a").isNotNull() & F.col("z_baro_b").isNotNull()
    return {
        "rx": F.col("x_b") - F.col("x_a"), "ry": F.col("y_b") - F.col("y_a"),
        "vx": F.col("vx_b") - F.col("vx_a"), "vy": F.col("vy_b") - F.col("vy_a"),
        "dz": F.when(both, F.col("z_baro_b") - F.col("z_baro_a")).otherwise(F.col("z_geo_b") - F.col("z_geo_a")),
        "vz": F.col("vz_b") - F.col("vz_a"),
        "zref": both.cast("int"),
    }


def _flagged(rel, setting: dict, cfg: Encounter):
    reach = max(float(setting["lookahead_s"]), cfg.step_s)
    t_in, t_out = zones.zone_span(*[rel[c] for c in STATE], setting["h_limit"], setting["v_limit"], cfg)
    return t_in < F.least(t_out, F.lit(reach))


def flagged_pairs(
    rows: DataFrame, setting: dict, *, keys=("day",), cfg: Encounter = ENCOUNTER, crowd: int | None = None,
    cells: bool | None = None,
) -> DataFrame:
    """Pair-seconds inside the zone now or within the lookahead.

    ``rows`` are presence rows; pairs are formed between legs of the same
    second. The zone test is part of the join condition, so only flagged pairs
    leave the join, and both sides share one shuffle. A second that holds far
    more rows than others is cut by adaptive skew-join handling, which splits
    both sides by map output. Two further measures can be asked for:

    * ``crowd``: seconds with more aircraft than this are cut into parts and
      joined part by part (exact, no pair twice). It counts the rows first, so
      use it on stored presence rows rather than on a long lazy chain;
    * ``cells`` (default: when the prune radius is smaller than the volume): a
      grid cell joins the key and each aircraft meets only its own and the
      neighbouring cells.
    """
    second = [*keys, "t"]
    rows = rows.filter(F.col("r") <= setting["radius_nm"]).select(*second, *SIDE)
    reach = zones.prune_radius(setting["h_limit"], setting["lookahead_s"], cfg)
    if cells is None:
        cells = reach < setting["radius_nm"]
    near = F.hypot(F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")) <= reach
    rel = relative_state()
    test = near & _flagged(rel, setting, cfg)

    def joined(a, b, extra=()):
        left, right, on = _sides(a, b, second, extra)
        return left.join(right, on & test).drop(*extra, *[f"_{k}" for k in (*second, *extra)])

    def with_cells(df):
        return df.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})

    def neighbours(df):
        around = F.explode(F.array(*[
            F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"))
            for i in (-1, 0, 1) for j in (-1, 0, 1)
        ]))
        return df.withColumn("_c", around).withColumns({"cx": F.col("_c.cx"), "cy": F.col("_c.cy")}).drop("_c")

    if cells:
        rows = with_cells(rows)
        out = joined(rows, neighbours(rows), ("cx", "cy"))
    elif crowd is None:
        out = joined(rows, rows)
    else:
        hot = crowded_seconds(rows, second, crowd)
        calm = rows.join(hot, second, "left_anti")
        busy = rows.join(hot, second).withColumn("_part", F.pmod(F.xxhash64("leg"), F.col("_parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        a = busy.withColumn("pa", F.col("_part")).withColumn("pb", every)
        b = busy.withColumn("pb", F.col("_part")).withColumn("pa", every)
        out = joined(calm, calm).unionByName(joined(a, b, ("pa", "pb")))
    # renamed through pin: as plain aliases each of them would double the number of
    # variants of the join condition that the optimizer derives as constraints
    named = {"a": "leg_a", "b": "leg_b", "tra": "track_a", "trb": "track_b", "pha": "phase_a", "phb": "phase_b",
             "ia": "interpolated_a", "ib": "interpolated_b"}
    named |= {f"{c}{s}": f"{c}_{s}" for s in ("a", "b") for c in ("x", "y", "h", "r")}
    cols = {**rel, **{n: F.col(c) for n, c in named.items()}}
    return pin(out, cols).select(*second, *cols)


# ---------------------------------------------------------------- tiers ----

def within_volume(pairs: DataFrame, radius_nm, ceiling_ft) -> DataFrame:
    """Pair-seconds with both aircraft inside the cylinder."""
    return pairs.filter(
        (F.col("ra") <= radius_nm) & (F.col("rb") <= radius_nm)
        & (F.col("ha") <= ceiling_ft) & (F.col("hb") <= ceiling_ft)
    )


def tier_column(tiers):
    return F.array(*[
        F.struct(F.lit(n).alias("tier"), F.lit(float(h)).alias("h_lim"), F.lit(float(v)).alias("v_lim"))
        for n, h, v in tiers
    ])


def evaluate_tiers(pairs: DataFrame, spec: Spec, cfg: Encounter = ENCOUNTER, lookahead=None) -> DataFrame:
    """One row per pair-second and tier with observed / predicted flags and separations."""
    p = pairs.withColumn("_t", F.explode(tier_column(spec.tiers))).select(*pairs.columns, "_t.*")
    return evaluate(p, spec.lookahead_s if lookahead is None else lookahead, cfg)


def evaluate(p: DataFrame, lookahead, cfg: Encounter = ENCOUNTER) -> DataFrame:
    """Flags and separations against the columns h_lim and v_lim of each row."""
    args = [F.col(c) for c in STATE]
    h, v = F.col("h_lim"), F.col("v_lim")
    t_in, t_out = zones.zone_span(*args, h, v, cfg)
    look = lookahead if isinstance(lookahead, str) else F.lit(float(lookahead))
    look = F.col(look) if isinstance(look, str) else look
    t_free = F.when(
        F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") > cfg.still * cfg.still,
        -(F.col("rx") * F.col("vx") + F.col("ry") * F.col("vy")) / (F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")),
    ).otherwise(0.0)
    p = pin(p, {"_in": t_in, "_out": t_out, "_free": F.greatest(t_free, F.lit(0.0))})
    p = p.withColumns({
        "observed": F.col("_in") < F.least(F.col("_out"), F.lit(float(cfg.step_s))),
        "_ahead": F.col("_in") < F.least(F.col("_out"), look),
        "_ts": F.least(F.col("_free"), F.lit(float(cfg.step_s))),
        "t_cpa": F.least(F.col("_free"), look),
    })

    def at(t):
        return (F.hypot(F.col("rx") + F.col("vx") * F.col(t), F.col("ry") + F.col("vy") * F.col(t)),
                F.col("dz") + F.col("vz") * F.col(t))

    d_step, z_step = at("_ts")
    d_cpa, z_cpa = at("t_cpa")
    p = p.withColumns({
        "predicted": F.col("_ahead") & ~F.col("observed"),
        "d_step": d_step, "z_step": z_step, "d_cpa": d_cpa, "z_cpa": z_cpa,
    })

    def norm(d, z):
        return F.greatest(d / h, F.abs(z) / v)

    return p.withColumns({
        "t_entry": F.when(F.col("predicted"), F.col("_in")),
        "s_now": norm(F.hypot("rx", "ry"), F.col("dz")),
        "s_step": norm(F.col("d_step"), F.col("z_step")),
        "s_cpa": norm(F.col("d_cpa"), F.col("z_cpa")),
    }).drop("_in", "_out", "_free", "_ahead", "_ts")


def pair_minimum(pairs: DataFrame, h_max: float, v_max: float, keys=("day",)) -> DataFrame:
    """Smallest sample-time distance per pair on seconds where both are real reports."""
    real = pairs.filter(~F.col("ia") & ~F.col("ib") & (F.abs("dz") < v_max))
    out = real.groupBy(*keys, "a", "b").agg(F.min(F.hypot("rx", "ry")).alias("d_min_nm"))
    return out.filter(F.col("d_min_nm") < h_max)


def compare_minima(left: DataFrame, right: DataFrame, tolerance_nm: float = 0.05, keys=("day",)) -> DataFrame:
    """Full outer match of two pair-minimum tables with agreement flag."""
    on = [*keys, "a", "b"]
    j = left.withColumnRenamed("d_min_nm", "d_left").join(
        right.withColumnRenamed("d_min_nm", "d_right"), on, "full_outer")
    status = (
        F.when(F.col("d_right").isNull(), "only_left").when(F.col("d_left").isNull(), "only_right").otherwise("both")
    )
    return j.withColumns({
        "status": status, "agree": F.coalesce(F.abs(F.col("d_left") - F.col("d_right")) <= tolerance_nm, F.lit(False)),
    })
