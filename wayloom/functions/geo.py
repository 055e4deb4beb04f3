"""Geometry as column expressions on degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M = 6371000.0
METRES_PER_DEGREE = 111320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0) * F.lit(EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bbox(lat: Column, lon: Column, radius_m: Column, clamp: float = 0.01) -> tuple[Column, Column]:
    """Half height and half width in degrees of the box around a circle."""
    return radius_m / F.lit(METRES_PER_DEGREE), radius_m / (F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(clamp)))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a closed ring of (lat, lon) corners, as one expression in generated code."""
    inside = F.lit(False)
    for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
        crosses = (F.lit(a) > lat) != (F.lit(c) > lat)
        at = F.lit(d - b) * (lat - F.lit(a)) / F.lit(c - a if c != a else 1.0) + F.lit(b)
        inside = inside != (crosses & (lon < at))
    return inside


def in_polygon(lat: Column, lon: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Within the first ring and none of the holes; null or non-finite points are outside."""
    out = in_ring(lat, lon, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(lat, lon, hole)
    return F.coalesce(out & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


HAVERSINE_SQL = """(2e0 * 6371000e0 * atan2(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)),
  sqrt(1 - (pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"""


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return HAVERSINE_SQL.format(a=a, b=b, c=c, d=d)
