"""Geodesic and planar distance expressions.

Two metres-per-degree conventions are kept apart on purpose: path lengths use
the haversine radius, projections the planar constant (0.11 % larger).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
MIN_SEGMENT_SQUARED_M = 1e-9
MAX_OFFSET_M = 150.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = lat1 - lat2
    dlon = (lon1 - lon2) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dlat * dlat + dlon * dlon) * METRES_PER_DEGREE


def nearest_on_path(lat: Column, lon: Column, segs: Column) -> Column:
    """Closest position on a path: struct(err2, seg_no, along_m).

    The minimum of (error, segment number) keeps the earliest segment among
    equally near ones. No shuffle: the path travels as an array in the row.
    Lambdas share no subexpressions, so each step binds its result for the next.
    """
    dy = lambda s: (lat - s["lat0"]) * METRES_PER_DEGREE
    dx = lambda s: (lon - s["lon0"]) * s["m_lon"]
    share = lambda s: F.when(
        s["len2"] > MIN_SEGMENT_SQUARED_M, (dx(s) * s["ab_x"] + dy(s) * s["ab_y"]) / s["safe_len2"]
    ).otherwise(0.0)
    placed = F.transform(
        segs, lambda s: F.struct(s.alias("s"), F.least(F.greatest(share(s), F.lit(0.0)), F.lit(1.0)).alias("t"))
    )
    missed = F.transform(
        placed,
        lambda p: F.struct(
            (dx(p["s"]) - p["t"] * p["s"]["ab_x"]).alias("ex"),
            (dy(p["s"]) - p["t"] * p["s"]["ab_y"]).alias("ey"),
            p["s"]["seg_no"].alias("seg_no"),
            (p["s"]["cum_m"] + p["t"] * p["s"]["len_m"]).alias("along_m"),
        ),
    )
    return F.array_min(
        F.transform(
            missed,
            lambda m: F.struct((m["ex"] * m["ex"] + m["ey"] * m["ey"]).alias("err2"), m["seg_no"].alias("seg_no"), m["along_m"].alias("along_m")),
        )
    )
