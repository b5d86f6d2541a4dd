"""Analytic entry and exit times of a moving pair into a separation zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import ENCOUNTER, TIERS, VOLUME, Encounter


def zone_span(rx: Column, ry: Column, vx: Column, vy: Column, dz: Column, vz: Column,
              h_limit, v_limit, cfg: Encounter = ENCOUNTER) -> tuple[Column, Column]:
    """Entry (not before 0) and exit second of the zone on an open-ended straight course.

    Each axis is a centre and a half-width in time. A motion below the "still"
    limit is replaced by that limit, which moves the bounds beyond any horizon
    and so leaves "inside all the time" or "never inside". The half-width is
    NaN for a miss, and no comparison with it holds.
    """
    a = F.greatest(vx * vx + vy * vy, F.lit(cfg.still * cfg.still))
    b = rx * vx + ry * vy
    h = _col(h_limit)
    h_half = F.sqrt(b * b - a * (rx * rx + ry * ry - h * h)) / a
    h_mid = -b / a
    # a level pair drifts away from its present height difference, so the limit itself stays outside
    drift = F.when(dz >= 0, cfg.still).otherwise(-cfg.still)
    rate = F.when(F.abs(vz) < cfg.still, drift).otherwise(vz)
    v_mid = -dz / rate
    v_half = _col(v_limit) / F.abs(rate)
    return (
        F.greatest(h_mid - h_half, v_mid - v_half, F.lit(0.0)),
        F.least(h_mid + h_half, v_mid + v_half),
    )


def zone_interval(
    rx: Column, ry: Column, vx: Column, vy: Column, dz: Column, vz: Column,
    h_limit, v_limit, horizon, cfg: Encounter = ENCOUNTER,
) -> tuple[Column, Column]:
    """Entry and exit second of the (h_limit, v_limit) zone within [0, horizon].

    Both are null when the pair is never inside. Limits and horizon may be
    numbers or columns (for example from a table of settings).
    """
    t_in, t_out = zone_span(rx, ry, vx, vy, dz, vz, h_limit, v_limit, cfg)
    t_out = F.least(t_out, _col(horizon).cast("double"))
    return F.when(t_in < t_out, t_in), F.when(t_in < t_out, t_out)


def closest_approach(
    rx: Column, ry: Column, vx: Column, vy: Column, dz: Column, vz: Column,
    horizon, cfg: Encounter = ENCOUNTER,
) -> tuple[Column, Column, Column]:
    """Time of the horizontal minimum in [0, horizon], distance and height difference there."""
    a = vx * vx + vy * vy
    free = F.when(a > cfg.still * cfg.still, -(rx * vx + ry * vy) / a).otherwise(0.0)
    t = F.least(F.greatest(free, F.lit(0.0)), _col(horizon).cast("double"))
    return t, F.hypot(rx + vx * t, ry + vy * t), dz + vz * t


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def prune_radius(h_limit: float, lookahead_s: float, cfg: Encounter = ENCOUNTER) -> float:
    """No pair further apart than this can enter the zone within the lookahead."""
    return h_limit + 2.0 * cfg.prune_speed_kt / 3600.0 * lookahead_s


def widest_setting(cfg: Encounter = ENCOUNTER, charted_ceiling_ft: float = 4000.0) -> dict:
    """Loosest limits any re-analysis can ask for; pairs are computed once with these."""
    name, h, v = TIERS[0]
    factor = max(cfg.tier_factors)
    return {
        "h_limit": h * factor,
        "v_limit": v * factor,
        "lookahead_s": max(cfg.lookahead_s, *cfg.lookahead_sensitivity_s),
        "radius_nm": max(VOLUME.radius_nm, VOLUME.radius_sensitivity_nm),
        "ceiling_ft": max(VOLUME.ceiling_cap_ft, charted_ceiling_ft, *VOLUME.ceiling_sensitivity_ft)
        + VOLUME.ceiling_buffer_ft,
    }
