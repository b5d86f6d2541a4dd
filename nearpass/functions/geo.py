"""Local plane, runway frame, flight phase and encounter geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import DEPARTURE_BASE, GEOMETRY, NM_PER_M, Geometry
from .plan import pin

# WGS84 ellipsoid
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
E2 = WGS84_F * (2.0 - WGS84_F)

# meridian arc length series (Snyder, USGS Professional Paper 1395, eq. 3-21)
ARC0 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
ARC2 = 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
ARC4 = 15 * E2**2 / 256 + 45 * E2**3 / 1024
ARC6 = 35 * E2**3 / 3072
# footpoint latitude series (eq. 3-26)
FOOT_E = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
FOOT2 = 3 * FOOT_E / 2 - 27 * FOOT_E**3 / 32
FOOT4 = 21 * FOOT_E**2 / 16 - 55 * FOOT_E**4 / 32
FOOT6 = 151 * FOOT_E**3 / 96


def meridian_arc(lat: float) -> float:
    """Metres along the meridian from the equator to ``lat`` degrees."""
    p = math.radians(lat)
    return WGS84_A * (ARC0 * p - ARC2 * math.sin(2 * p) + ARC4 * math.sin(4 * p) - ARC6 * math.sin(6 * p))


def _arc(p: Column) -> Column:
    return WGS84_A * (ARC0 * p - ARC2 * F.sin(2 * p) + ARC4 * F.sin(4 * p) - ARC6 * F.sin(6 * p))


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Degrees to NM east and north of the reference point.

    Ellipsoidal azimuthal-equidistant plane in the local ("Guam") form, which
    stays within a few decimetres of the geodesic over the study area.
    """
    p = F.radians(lat)
    w = F.sqrt(1 - E2 * F.pow(F.sin(p), 2))
    x = F.radians(lon - lon0) * WGS84_A * F.cos(p) / w
    y = _arc(p) - meridian_arc(lat0) + x * x * F.tan(p) * w / (2 * WGS84_A)
    return x * NM_PER_M, y * NM_PER_M


def unproject(x: Column, y: Column, lat0: float, lon0: float, rounds: int = 3) -> tuple[Column, Column]:
    """NM east and north back to degrees (unrolled footpoint iteration)."""
    xm, ym = x / NM_PER_M, y / NM_PER_M
    m0 = meridian_arc(lat0)
    p = F.lit(math.radians(lat0))
    for _ in range(rounds):
        w = F.sqrt(1 - E2 * F.pow(F.sin(p), 2))
        mu = (m0 + ym - xm * xm * F.tan(p) * w / (2 * WGS84_A)) / (WGS84_A * ARC0)
        p = mu + FOOT2 * F.sin(2 * mu) + FOOT4 * F.sin(4 * mu) + FOOT6 * F.sin(6 * mu)
    w = F.sqrt(1 - E2 * F.pow(F.sin(p), 2))
    return F.degrees(p), lon0 + F.degrees(xm * w / (WGS84_A * F.cos(p)))


def azimuths(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Forward and reverse true bearings of a short geodesic (mid-latitude form)."""
    mid = F.radians((lat1 + lat2) / 2)
    w2 = 1 - E2 * F.pow(F.sin(mid), 2)
    prime = WGS84_A / F.sqrt(w2)
    merid = WGS84_A * (1 - E2) / F.pow(w2, 1.5)
    dlon = F.radians(lon2 - lon1)
    course = F.atan2(prime * F.cos(mid) * dlon, merid * F.radians(lat2 - lat1))
    half = F.degrees(dlon * F.sin(mid)) / 2
    fwd = F.degrees(course) - half
    back = F.degrees(course) + half + 180
    return F.pmod(fwd, F.lit(360.0)), F.pmod(back, F.lit(360.0))


def flat_offset(lat: Column, lon: Column, lat0, lon0) -> tuple[Column, Column]:
    """East and north NM from a point with a flat cosine-of-latitude scale."""
    scale = F.cos(F.radians(F.lit(lat0)))
    return (lon - lon0) * 60.0 * scale, (lat - lat0) * 60.0


def flat_distance(lat: Column, lon: Column, lat0, lon0) -> Column:
    dx, dy = flat_offset(lat, lon, lat0, lon0)
    return F.hypot(dx, dy)


def wrap180(deg: Column) -> Column:
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def track_delta(a: Column, b) -> Column:
    """Absolute angle between two headings, 0..180 degrees."""
    return F.abs(wrap180(a - b))


def runway_frame(dx: Column, dy: Column, bearing: float) -> tuple[Column, Column]:
    """Along-track (positive before the threshold) and cross-track distance."""
    s, c = math.sin(math.radians(bearing)), math.cos(math.radians(bearing))
    return -(dx * s + dy * c), dx * c - dy * s


def with_phase(df: DataFrame, runways, cfg: Geometry = GEOMETRY) -> DataFrame:
    """Phase code of each row: 0 other, 1+k arrival to end k, 101+k departure from end k.

    The K runway ends are unrolled, so the row count never grows with K: first
    the frame of every end, then the best (score, k, code) struct of those that
    match. Reads x, y, track, h and vrate.
    """
    frame = {}
    for k, (_, tx, ty, bearing) in enumerate(runways):
        along, cross = runway_frame(F.col("x") - tx, F.col("y") - ty, bearing)
        frame |= {f"_al{k}": along, f"_cr{k}": F.abs(cross), f"_tu{k}": track_delta(F.col("track"), bearing)}
    climbing = F.coalesce(F.col("vrate") >= cfg.departure_vrate_fpm, F.lit(False))
    df = pin(df, {**frame, "_climb": climbing})
    options = []
    for k in range(len(runways)):
        along, cross, turn = F.col(f"_al{k}"), F.col(f"_cr{k}"), F.col(f"_tu{k}")
        far = F.when(F.col("_climb"), (along > -cfg.departure_dist_nm) & (along < cfg.departure_before_nm)).otherwise(
            (along > cfg.past_threshold_nm) & (along < cfg.arrival_dist_nm) & (F.col("h") < cfg.arrival_height_ft))
        code = F.when(F.col("_climb"), DEPARTURE_BASE + 1 + k).otherwise(1 + k)
        score = turn + cfg.xtrack_weight * cross
        options.append(F.when(
            (cross < cfg.phase_xtrack_nm) & (turn < cfg.phase_track_deg) & far,
            F.struct(score.alias("s"), F.lit(k).alias("k"), code.alias("c"))))
    return pin(df, {"phase": F.coalesce(F.array_min(F.array(*options))["c"], F.lit(0))}).drop(*frame, "_climb")


def phase_runway_index(code: Column) -> Column:
    return (
        F.when(code == 0, -1)
        .when(code > DEPARTURE_BASE, code - DEPARTURE_BASE - 1)
        .otherwise(code - 1)
    )


def phase_group(code: Column) -> Column:
    return F.when(code == 0, "other").when(code > DEPARTURE_BASE, "departure").otherwise("arrival")


def phase_runway(code: Column, runways) -> Column:
    """Runway end name of a phase code (null for other)."""
    names = F.array(*[F.lit(r[0]) for r in runways])
    return F.when(code > 0, F.element_at(names, (phase_runway_index(code) + 1).cast("int")))


def phase_label(code: Column, runways) -> Column:
    return F.when(code == 0, "other").otherwise(
        F.concat(phase_group(code), F.lit("_"), phase_runway(code, runways))
    )


def nearest_threshold(x: Column, y: Column, runways) -> Column:
    return F.least(*[F.hypot(x - tx, y - ty) for _, tx, ty, _ in runways])


def with_geometry_class(df: DataFrame, runways, cfg: Geometry = GEOMETRY) -> DataFrame:
    """Encounter class at the closest point; the first matching rule wins."""
    bearings = F.array(*[F.lit(float(r[3])) for r in runways])

    def bearing(k):
        return F.element_at(bearings, (F.greatest(k, F.lit(0)) + 1).cast("int"))

    def near(side):
        d = nearest_threshold(F.col(f"x{side}"), F.col(f"y{side}"), runways)
        return (d <= cfg.runway_area_nm) & (F.col(f"h{side}") < cfg.runway_area_ft)

    df = pin(df, {
        "_turn": track_delta(F.col("tra"), F.col("trb")),
        "_ka": phase_runway_index(F.col("pha")), "_kb": phase_runway_index(F.col("phb")),
        "_near": near("a") & near("b"),
    })
    turn, ka, kb = F.col("_turn"), F.col("_ka"), F.col("_kb")
    aligned = (ka >= 0) & (kb >= 0)
    cls = (
        F.when(F.col("_near"), "runway_area")
        .when(aligned & (ka == kb) & (turn < cfg.in_trail_max_deg), "in_trail_same_runway")
        .when(aligned & (ka != kb) & (track_delta(bearing(ka), bearing(kb)) <= cfg.parallel_heading_deg), "parallel_runways")
        .when(turn.between(cfg.in_trail_max_deg, cfg.crossing_max_deg), "crossing")
        .when(turn > cfg.crossing_max_deg, "head_on")
        .otherwise("other")
    )
    return pin(df, {"geometry_class": cls}).drop("_turn", "_ka", "_kb", "_near")
