"""Coordinates: distances, plausibility, and the Taiwan TM2 grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: mean earth radius, GRS80 ellipsoid, TM2 zone 121
RADIUS_M = 6371008.8
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
TM2_SCALE, TM2_FALSE_EASTING, TM2_MERIDIAN = 0.9999, 250000.0, 121.0
# fixed values: where coordinates are plausible
LON_RANGE, LAT_RANGE = (119.0, 122.5), (21.5, 26.5)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def plausible(lon: Column, lat: Column) -> Column:
    """Both given and inside the plausible box (edges belong to it)."""
    return F.coalesce(lon.between(*LON_RANGE) & lat.between(*LAT_RANGE), F.lit(False))


def with_wgs84(df: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
    """``df`` with ``name``: struct<lon, lat> of TM2 grid metres, by the inverse transverse Mercator series.

    The series goes step by step over helper columns, so that no step is written out
    (and compiled) as often as later steps use it.
    """
    e2 = 2 * GRS80_F - GRS80_F**2
    second = e2 / (1 - e2)
    n = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    arc = GRS80_A * TM2_SCALE * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    col = F.col
    mu = col("_mu")
    foot = (
        mu + (1.5 * n - 27 / 32 * n**3) * F.sin(2 * mu) + (21 / 16 * n**2 - 55 / 32 * n**4) * F.sin(4 * mu)
        + 151 / 96 * n**3 * F.sin(6 * mu) + 1097 / 512 * n**4 * F.sin(8 * mu)
    )
    s, c, t, root, d = (col(k) for k in ("_sin", "_cos", "_tan", "_root", "_d"))
    c1, t1, d2 = col("_c1"), col("_t1"), col("_d2")
    lat = col("_foot") - (1 - e2 * s * s) / (1 - e2) * t * d2 * (
        F.lit(0.5) - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * second) * d2 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * second - 3 * c1 * c1) * d2 * d2 / 720
    )
    lon = d * (1 - (1 + 2 * t1 + c1) * d2 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * second + 24 * t1 * t1) * d2 * d2 / 120) / c
    steps = [
        {"_mu": y / arc}, {"_foot": foot}, {"_sin": F.sin("_foot"), "_cos": F.cos("_foot"), "_tan": F.tan("_foot")},
        {"_root": F.sqrt(1 - e2 * s * s), "_c1": second * c * c, "_t1": t * t},
        {"_d": (x - TM2_FALSE_EASTING) * root / (GRS80_A * TM2_SCALE)}, {"_d2": d * d},
        {name: F.struct((F.degrees(lon) + TM2_MERIDIAN).alias("lon"), F.degrees(lat).alias("lat"))},
    ]
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.drop("_mu", "_foot", "_sin", "_cos", "_tan", "_root", "_c1", "_t1", "_d", "_d2")
