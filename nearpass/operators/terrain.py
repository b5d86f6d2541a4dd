"""Ground elevation under each position from a raster table."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame, functions as F

from ..settings import FT_PER_M


@dc.dataclass(frozen=True)
class Raster:
    """Web-Mercator pixel raster: zoom, pixel of the first node, size in nodes."""

    zoom: int
    origin_px: tuple
    width: int
    height: int
    tile_px: int = 256


def _pixel(raster: Raster, lat, lon):
    span = float(2**raster.zoom * raster.tile_px)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-85.0)), F.lit(85.0)))
    fx = (lon + 180.0) / 360.0 * span - raster.origin_px[0]
    import math

    fy = (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * span - raster.origin_px[1]

    def clamp(v, n):
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(n - 1.001))

    return clamp(fx, raster.width), clamp(fy, raster.height)


def ground_elevation(points: DataFrame, dem: DataFrame, raster: Raster) -> DataFrame:
    """Bilinear elevation ``ground_ft``; positions outside take the nearest edge.

    Every raster node is sent to the four cells it is a corner of, so each
    position meets its four corners in one equality join on the cell.
    """
    corners = dem.select(
        F.explode(F.array(*[
            F.struct((F.col("ix") - i).alias("cx"), (F.col("iy") - j).alias("cy"),
                     F.lit(f"{i}{j}").alias("k"), F.col("elev_m").alias("e"))
            for i in (0, 1) for j in (0, 1)
        ])).alias("c")
    ).select("c.*")
    cells = corners.groupBy("cx", "cy").agg(
        *[F.max(F.when(F.col("k") == k, F.col("e"))).alias(f"e{k}") for k in ("00", "10", "01", "11")]
    )
    fx, fy = _pixel(raster, F.col("latitude"), F.col("longitude"))
    p = points.withColumns({"_fx": fx, "_fy": fy})
    p = p.withColumns({"cx": F.floor("_fx"), "cy": F.floor("_fy")})
    tx, ty = F.col("_fx") - F.col("cx"), F.col("_fy") - F.col("cy")
    elev = (
        F.col("e00") * (1 - tx) * (1 - ty) + F.col("e10") * tx * (1 - ty)
        + F.col("e01") * (1 - tx) * ty + F.col("e11") * tx * ty
    )
    out = p.join(cells, ["cx", "cy"], "left").withColumn("ground_ft", elev * FT_PER_M)
    return out.drop("_fx", "_fy", "cx", "cy", "e00", "e10", "e01", "e11")
