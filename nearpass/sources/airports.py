"""Runway ends of many airports from the public airport tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import azimuths


def match_airports(airports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Airports by ident, else by gps_code (case-insensitive). ``wanted`` holds icao."""
    a = airports.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("p"), F.upper("ident").alias("icao")), F.struct(F.lit(1).alias("p"), F.upper("gps_code").alias("icao")))).alias("_k"))
    j = a.select(*airports.columns, "_k.*").join(wanted.select(F.upper("icao").alias("icao")), "icao")
    best = j.groupBy("icao").agg(F.min_by(F.struct(*airports.columns), F.struct("p", "ident")).alias("r"))
    return best.select("icao", "r.*")


def runway_ends(runways: DataFrame) -> DataFrame:
    """Two rows per open runway with both thresholds known; bearing to the other end."""
    ok = runways.filter(F.coalesce("closed", F.lit(0)) != 1).dropna(subset=[
        f"{s}_{c}" for s in ("le", "he") for c in ("ident", "latitude_deg", "longitude_deg")])
    fwd, back = azimuths(*(F.col(c) for c in ("le_latitude_deg", "le_longitude_deg", "he_latitude_deg", "he_longitude_deg")))
    ends = F.array(*[
        F.struct(F.col(f"{s}_ident").alias("runway"), F.col(f"{s}_latitude_deg").alias("lat"), F.col(f"{s}_longitude_deg").alias("lon"), b.alias("bearing"))
        for s, b in (("le", fwd), ("he", back))])
    return ok.select(F.col("airport_ident").alias("airport"), F.explode(ends).alias("e")).select("airport", "e.*")
