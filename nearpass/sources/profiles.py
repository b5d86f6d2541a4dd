"""Airport profiles: geometry, presets, overrides, flows."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..settings import APPROACH, GEOMETRY, PRESETS, VOLUME, Airport, Approach, Geometry, Volume


def parallel_spacing(runways: DataFrame, cfg: Geometry = GEOMETRY) -> DataFrame:
    """Smallest spacing of parallel runway centrelines per airport.

    ``runways`` holds airport, runway, bearing and threshold x, y (NM). The
    self-join stays inside an airport and carries the 10-degree heading test;
    the minimum is combined before the shuffle.
    """
    b = runways.select(*[F.col(c).alias(f"{c}_b") for c in ("airport", "runway", "bearing", "x", "y")])
    on = (
        (F.col("airport") == F.col("airport_b")) & (F.col("runway") < F.col("runway_b"))
        & (geo.track_delta(F.col("bearing"), F.col("bearing_b")) <= cfg.spacing_heading_deg)
    )
    rad = F.radians("bearing")
    gap = F.abs((F.col("x_b") - F.col("x")) * F.cos(rad) - (F.col("y_b") - F.col("y")) * F.sin(rad))
    return (
        runways.join(b, on).select("airport", gap.alias("gap")).filter(F.col("gap") > 0.01)
        .groupBy("airport").agg(F.min("gap").alias("spacing_nm"))
    )


def effective_params(profiles: DataFrame, overrides: DataFrame, names, defaults: dict) -> DataFrame:
    """Parameter values per airport: explicit override, else preset, else default.

    ``profiles`` holds airport, preset; ``overrides`` holds airport, name, value.
    Returns long rows (airport, name, value, origin). Unknown presets or names
    show as origin "unknown" so that a whole set of airports can be checked in one pass.
    """
    preset_rows = F.array(*[
        F.struct(F.lit(p).alias("preset"), F.lit(k).alias("name"), F.lit(float(v)).alias("value"))
        for p, kv in PRESETS.items() for k, v in kv.items()
    ])
    base = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(defaults[n])).alias("d")) for n in names])
    rows = profiles.withColumn("_d", F.explode(base)).select(*profiles.columns, "_d.name", "_d.d")
    from_preset = F.get(
        F.filter(preset_rows, lambda p: (p["preset"] == F.col("preset")) & (p["name"] == F.col("name"))), F.lit(0)
    )["value"]
    rows = rows.withColumn("_p", from_preset)
    over = overrides.select("airport", "name", F.col("value").alias("_o"))
    out = rows.join(over, ["airport", "name"], "full_outer")
    return out.select(
        "airport", "name", F.coalesce("_o", "_p", "d").alias("value"),
        F.when(F.col("d").isNull(), "unknown").when(F.col("_o").isNotNull(), "override")
        .when(F.col("_p").isNotNull(), "preset").otherwise("default").alias("origin"),
    )


def read_profile(doc: dict) -> tuple[Airport, Approach, dict]:
    """One airport profile (a parsed YAML mapping) to settings; wrong input raises."""
    preset = doc.get("preset", "training_ga")
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; available: {', '.join(PRESETS)}")
    names = {f.name for f in dc.fields(Approach)}
    values = {**PRESETS[preset], **(doc.get("overrides") or {})}
    unknown = sorted(set(values) - names)
    if unknown:
        raise ValueError(f"unknown override(s) {unknown}")
    lat, lon = float(doc["latitude"]), float(doc["longitude"])
    approach = dc.replace(APPROACH, arrivals_only=bool(doc.get("assume_arrivals_dataset", False)), **values)
    runways = {str(k): tuple(map(float, v)) for k, v in doc["runways"].items()}
    flows = doc.get("flows") or {}
    missing = sorted({str(r) for rs in flows.values() for r in rs} - set(runways))
    if missing:
        raise ValueError(f"flows name unknown runway ends {missing}")
    space = doc.get("airspace")
    if not space:
        raise ValueError("profile has no airspace block")
    ceiling = float(space["ceiling_ft_msl"]) - float(doc["elevation_ft"])
    if not VOLUME.ceiling_min_ft <= ceiling <= VOLUME.ceiling_max_ft:
        raise ValueError(f"charted ceiling is {ceiling:.0f} ft above the field, outside the plausible band")
    mode = str(space.get("ceiling_mode", "auto")).lower()
    if mode not in ("auto", "fixed"):
        raise ValueError("ceiling_mode must be auto or fixed")
    ends = tuple((n, *_plane_point(la, lo, lat, lon), b) for n, (la, lo, b) in runways.items())
    airport = Airport(
        icao=str(doc["icao"]).upper(), latitude=lat, longitude=lon, elevation_ft=float(doc["elevation_ft"]),
        timezone=doc.get("timezone", "UTC"), runways=ends,
        flows=tuple((str(r), str(label)) for label, rs in flows.items() for r in rs),
    )
    return airport, approach, {
        "ceiling_ft": ceiling, "ceiling_mode": mode, "radius_nm": float(space.get("radius_nm", VOLUME.radius_nm)),
        "airspace_class": str(space.get("class", "C")),
    }


def _plane_point(lat, lon, lat0, lon0):
    """Plane coordinates of one threshold, rounded to centimetres (a handful of numbers)."""
    import math

    p = math.radians(lat)
    w = math.sqrt(1 - geo.E2 * math.sin(p) ** 2)
    x = math.radians(lon - lon0) * geo.WGS84_A * math.cos(p) / w
    y = geo.meridian_arc(lat) - geo.meridian_arc(lat0) + x * x * math.tan(p) * w / (2 * geo.WGS84_A)
    return round(x / 1852.0, 6), round(y / 1852.0, 6)


def flow_of(runway: Column, flows) -> Column:
    """Flow label of a runway end, 'other' when it has none."""
    out = None
    for name, label in flows:
        cond = runway == name
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.lit("other") if out is None else out.otherwise("other")


def auto_flows(runways: DataFrame, cfg: Geometry = GEOMETRY) -> DataFrame:
    """Group runway ends by heading when an airport states no flows.

    The ends of one airport (a few, by construction of runways) are folded in
    order: an end joins the first group whose head is within the tolerance.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "runway", F.col("bearing").cast("double").alias("bearing"))))
    per = runways.groupBy("airport").agg(rows.alias("ends"))

    def assign(heads, end):
        near = F.filter(heads, lambda h: geo.track_delta(end["bearing"], h) <= cfg.flow_heading_deg)
        return F.when(F.size(near) > 0, heads).otherwise(F.concat(heads, F.array(end["bearing"])))

    per = per.withColumn("heads", F.aggregate("ends", F.array().cast("array<double>"), assign))
    one = per.select("airport", "heads", F.explode("ends").alias("e"))
    head = F.get(F.filter("heads", lambda h: geo.track_delta(F.col("e.bearing"), h) <= cfg.flow_heading_deg), F.lit(0))
    number = F.pmod(F.bround(head / 10.0).cast("int") * 10, F.lit(360))
    return one.select("airport", F.col("e.runway").alias("runway"), F.concat(F.lit("flow_"), F.lpad(number.cast("string"), 3, "0")).alias("flow"))
