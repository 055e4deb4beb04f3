"""Planar geometry of lines and polygons in degrees, as column expressions over arrays.

A path is an array of struct(x, y), x the longitude; a ring is a closed path; an edge is struct(ax, ay, bx, by). Nothing
here shuffles: each test is a projection over the row that holds both shapes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import haversine_m


def edges(path: Column) -> Column:
    """The edges between neighbours of a path; a closed ring has its last point first, so all of it is covered."""
    ahead = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), ahead, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return F.when(F.size(path) >= 2, pairs).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against the edges of a ring."""

    def crossed(e: Column) -> Column:
        return F.when((e["by"] > y) != (e["ay"] > y), x < (e["ax"] - e["bx"]) * (y - e["by"]) / (e["ay"] - e["by"]) + e["bx"]).otherwise(F.lit(False))

    return F.aggregate(ring, F.lit(False), lambda odd, e: odd != crossed(e))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Within the first ring and none of the others; points that aren't finite are outside."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.coalesce(ring_contains(rings[0], x, y) & ~F.exists(holes, lambda r: ring_contains(r, x, y)) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def edge_metres(x: Column, y: Column, e: Column) -> Column:
    """From a point to an edge: projected on the locally flat map, kept within the edge, measured on the sphere."""
    scale = F.cos(F.radians(y))
    dx, dy = e["bx"] * scale - e["ax"] * scale, e["by"] - e["ay"]
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(((x * scale - e["ax"] * scale) * dx + (y - e["ay"]) * dy) / size)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return haversine_m(y, x, e["ay"] + t * (e["by"] - e["ay"]), e["ax"] + t * (e["bx"] - e["ax"]))


def line_metres(x: Column, y: Column, path_edges: Column) -> Column:
    """To the nearest edge; infinite if there is none."""
    return F.coalesce(F.array_min(F.transform(path_edges, lambda e: edge_metres(x, y, e))), F.lit(float("inf")))


def boundary_metres(x: Column, y: Column, rings: Column) -> Column:
    """0 inside, else to the nearest edge of any ring."""
    return F.when(contains(rings, x, y), 0.0).otherwise(F.array_min(F.transform(rings, lambda r: line_metres(x, y, r))))


def _turn(px, py, qx, qy, rx, ry) -> Column:
    return (qy - py) * (rx - qx) - (qx - px) * (ry - qy)


def _between(px, py, qx, qy, rx, ry) -> Column:
    return (F.least(px, rx) <= qx) & (qx <= F.greatest(px, rx)) & (F.least(py, ry) <= qy) & (qy <= F.greatest(py, ry))


def _turns(e: Column, f: Column) -> tuple[Column, Column, Column, Column]:
    a, b, c, d = (e["ax"], e["ay"]), (e["bx"], e["by"]), (f["ax"], f["ay"]), (f["bx"], f["by"])
    return _turn(*a, *b, *c), _turn(*a, *b, *d), _turn(*c, *d, *a), _turn(*c, *d, *b)


def crosses(e: Column, f: Column) -> Column:
    """Edges that cross in a point inside both."""
    a, b, c, d = _turns(e, f)
    return (a * b < 0) & (c * d < 0)


def touches(e: Column, f: Column) -> Column:
    """Edges that share a point."""
    a, b, c, d = _turns(e, f)
    p, q, r, s = (e["ax"], e["ay"]), (e["bx"], e["by"]), (f["ax"], f["ay"]), (f["bx"], f["by"])
    on = ((a == 0) & _between(*p, *r, *q)) | ((b == 0) & _between(*p, *s, *q)) | ((c == 0) & _between(*r, *p, *s)) | ((d == 0) & _between(*r, *q, *s))
    return ((a * b < 0) & (c * d < 0)) | on


def covered(rings: Column, x: Column, y: Column) -> Column:
    """Inside or on an edge."""
    on = F.exists(rings, lambda r: F.exists(r, lambda e: (_turn(e["ax"], e["ay"], e["bx"], e["by"], x, y) == 0) & _between(e["ax"], e["ay"], x, y, e["bx"], e["by"])))
    return contains(rings, x, y) | on


def area_relation(basis: Column, x: Column, y: Column, path: Column, rings: Column) -> Column:
    """INSIDE, INTERSECTS, OUTSIDE or UNDETERMINED: how a point, line or polygon (``path``) lies to an area (``rings``).

    A line or polygon is inside if all its points are covered and no edge crosses the boundary; a shape by nature a line
    or polygon but without one (basis NONE) is undetermined, never taken by its point.
    """
    own = edges(path)
    met = lambda test: F.exists(own, lambda e: F.exists(rings, lambda r: F.exists(r, lambda f: test(e, f))))
    inside = F.forall(path, lambda p: covered(rings, p["x"], p["y"])) & ~met(crosses)
    around = (basis == "POLYGON") & F.exists(rings, lambda r: F.exists(r, lambda f: contains(F.array(own), f["ax"], f["ay"])))
    some = F.exists(path, lambda p: contains(rings, p["x"], p["y"])) | met(touches) | around
    return (
        F.when(basis == "NONE", "UNDETERMINED")
        .when(basis == "POINT", F.when(covered(rings, x, y), "INSIDE").otherwise("OUTSIDE"))
        .when(inside, "INSIDE").when(some, "INTERSECTS").otherwise("OUTSIDE")
    )


def path_metres(path: Column) -> Column:
    return F.aggregate(edges(path), F.lit(0.0), lambda s, e: s + haversine_m(e["ay"], e["ax"], e["by"], e["bx"]))
