"""Covers of many boundaries against all pairs, and scopes of compositions against a plain twin."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayloom.operators.areas import containing
from wayloom.plans import catalog
from wayloom.plans.geometry import AREAS
from wayloom.plans.scopes import CIRCLE, composed

EDGE = "array<array<struct<ax:double,ay:double,bx:double,by:double>>>"


def ring_edges(ring):
    return list(zip(ring, [*ring[1:], ring[0]], strict=True))


def odd(es, x, y):
    out = False
    for (ax, ay), (bx, by) in es:
        if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
            out = not out
    return out


def within(rings, x, y):
    return bool(rings) and odd(rings[0], x, y) and not any(odd(h, x, y) for h in rings[1:])


def test_covers_equal_all_pairs(spark):
    """Polygons of all sizes, dented, with holes, thin, with many corners; points beside corners, on edges and nowhere."""
    rng = random.Random(3)
    areas = {}
    for k in range(60):
        x, y, r = rng.uniform(-170, 170), rng.uniform(-80, 80), 10 ** rng.uniform(-3, 0.9)
        n = rng.choice([3, 5, 12, 200])
        ring = [(x + r * rng.uniform(0.4, 1) * math.cos(6.283 * i / n), y + r * rng.choice([1, 0.01]) * rng.uniform(0.4, 1) * math.sin(6.283 * i / n)) for i in range(n)]
        hole = [(x + r * 0.2 * math.cos(2.1 * i), y + r * 0.2 * math.sin(2.1 * i)) for i in range(3)]
        areas[k] = [ring_edges(ring)] + ([ring_edges(hole)] if k % 3 == 0 else [])
    areas[60] = [ring_edges([(-60.0, -35.0), (-58.0, -35.0), (-58.0, -33.0), (-60.0, -33.0)])]  # along cells
    points = []
    for es in areas.values():
        for (ax, ay), (bx, by) in rng.choices([e for ring in es for e in ring], k=12):
            points += [(ax, ay), ((ax + bx) / 2, (ay + by) / 2), (ax + rng.gauss(0, 0.01), ay + rng.gauss(0, 0.01)), (ax + rng.gauss(0, 1), ay + rng.gauss(0, 1))]
    points = [(x, y) for x, y in points if abs(x) <= 180 and abs(y) <= 90]
    want = {(i, k) for i, (x, y) in enumerate(points) for k, rings in areas.items() if within(rings, x, y)}
    points += [(None, 1.0), (float("nan"), 0.0), (999.0, 0.0)]
    rows = [(k, [[(*a, *b) for a, b in ring] for ring in rings]) for k, rings in areas.items()] + [(98, None), (99, []), (100, [[]]), (101, [[(float("nan"), 0.0, 1.0, 1.0)]])]
    frame = spark.createDataFrame(rows, f"area_id long, rings {EDGE}")
    asked = spark.createDataFrame([(i, x, y, 7) for i, (x, y) in enumerate(points)], "i long, longitude double, latitude double, area int")
    got = [(r.i, r.area_id) for r in containing(asked, frame).select("i", "area_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


# -- the twin


def turn(p, q, r):
    return (q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1])


def between(p, q, r):
    return min(p[0], r[0]) <= q[0] <= max(p[0], r[0]) and min(p[1], r[1]) <= q[1] <= max(p[1], r[1])


def meet(e, f, touching):
    (a, b), (c, d) = e, f
    p, q, r, s = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    if p * q < 0 and r * s < 0:
        return True
    return touching and (p == 0 and between(a, c, b) or q == 0 and between(a, d, b) or r == 0 and between(c, a, d) or s == 0 and between(c, b, d))


def covers(rings, x, y):
    return within(rings, x, y) or any(turn(a, b, (x, y)) == 0 and between(a, (x, y), b) for ring in rings for a, b in ring)


def line(path):
    return list(zip(path[:-1], path[1:], strict=True))


def relation(basis, x, y, path, rings):
    if basis == "NONE":
        return "UNDETERMINED"
    if basis == "POINT":
        return "INSIDE" if covers(rings, x, y) else "OUTSIDE"
    sides = [f for ring in rings for f in ring]
    if all(covers(rings, *p) for p in path) and not any(meet(e, f, False) for e in line(path) for f in sides):
        return "INSIDE"
    if any(within(rings, *p) for p in path) or any(meet(e, f, True) for e in line(path) for f in sides) or basis == "POLYGON" and any(within([line(path)], *f[0]) for f in sides):
        return "INTERSECTS"
    return "OUTSIDE"


def sphere(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


class Case:
    """One composition, judged by the ordered rules."""

    def __init__(self, row):
        points = lambda p: None if p is None else [(q["x"], q["y"]) for q in p]
        self.k = row["experience_id"]
        self.hints = [h | {"path": points(h["path"])} for h in row["hints"]]
        self.members = [h for h in self.hints if h["state"] == "RESOLVED"]
        n = len(self.hints)
        self.grant = "DEFAULT" if n < 2 else {1: "WALK", 2: "ROUTE_LIKE"}.get(self.k // 4 % 3, "DEFAULT")
        self.dest = {0: 1, 1: 2, 2: "circle"}.get(self.k % 4)
        rings = {a: [ring_edges(r) for r in rs] for a, rs in AREAS.items()}
        self.target = rings.get(self.dest)
        self.anchor = rings[3]
        self.unit = {0: "area", 1: "route", 2: "broken"}.get(self.k % 7)

    def rel(self, m, rings):
        return relation(m["basis"], m["longitude"], m["latitude"], m["path"], rings)

    def holds(self, m, rings):
        r = self.rel(m, rings)
        return r == "INSIDE" or m["basis"] == "LINE" and r == "INTERSECTS"

    def routes(self):
        return [m for m in self.members if m["role"] == "route" and m["basis"] == "LINE"]

    def along(self, route, members):
        out = {}
        run = lambda rings: relation("LINE", 0, 0, route["path"], rings) in ("INSIDE", "INTERSECTS")
        quarters = [line(a["path"]) for a in members if a["role"] == "area" and a["basis"] == "POLYGON" and run([line(a["path"])])]
        for m in members:
            placed = m["latitude"] is not None
            if m["basis"] == "NONE" and not placed:
                r = "NO_MATERIAL_ANCHOR_RELATION"
            elif m["entity_id"] == route["entity_id"]:
                r = "ANCHOR_COMPONENT"
            elif m["basis"] == "POLYGON" and m["role"] != "area" and run([line(m["path"])]):
                r = "ON_ROUTE"
            elif any(self.rel(m, [q]) in ("INSIDE", "INTERSECTS") for q in quarters):
                r = "SAME_LOCAL_SCOPE"
            elif self.target and placed and not within(self.target, m["longitude"], m["latitude"]):
                r = "OUTSIDE_DESTINATION"
            else:
                r = "DESTINATION_COMPATIBLE_EXTENSION"
            out[m["entity_id"]] = r
        return out

    @staticmethod
    def verdict(found):
        if not {"ANCHOR_COMPONENT", "ON_ROUTE"} & set(found.values()):
            return "NO_MATERIAL_ANCHOR_RELATION"
        return "OUTSIDE_DESTINATION_BOUNDARY" if "OUTSIDE_DESTINATION" in found.values() else "PASSES"

    def scope(self):
        """(provenance or reason, relation, owned, semantics)."""
        areas, routes = [h for h in self.hints if h["role"] == "area"], self.routes()
        owned = None
        if len(routes) == 1:
            owned = routes[0]
        elif not routes and len(areas) == 1 and any(h["role"] == "waypoint" for h in self.hints) and areas[0]["state"] == "RESOLVED" and areas[0]["basis"] == "POLYGON":
            owned = areas[0]
        extends = self.grant == "ROUTE_LIKE" and self.unit is None
        if owned:
            r = relation(owned["basis"], 0, 0, owned["path"], self.target) if self.target else "UNKNOWN"
            if self.grant == "ROUTE_LIKE" or r in ("INSIDE", "INTERSECTS"):
                return ("CANDIDATE_ROUTE" if owned["role"] == "route" else "CANDIDATE_AREA"), r, owned, "DESCRIPTIVE"
            if r == "OUTSIDE":
                return "SCOPE_BEYOND_DESTINATION_NOT_AUTHORIZED", r, None, None
        if self.unit == "area" and not (len(routes) > 1 or not routes and len(areas) > 1) and self.target:
            ring = [e[0] for e in self.anchor[0]]
            if relation("POLYGON", 0, 0, [*ring, ring[0]], self.target) == "OUTSIDE":
                return ("WORK_UNIT_ANCHOR", "OUTSIDE", None, "STRICT") if self.grant == "ROUTE_LIKE" else ("SCOPE_BEYOND_DESTINATION_NOT_AUTHORIZED", "OUTSIDE", None, None)
        if self.dest is None:
            return "DESTINATION_GEOGRAPHY_UNKNOWN", None, None, None
        return ("DESTINATION_POINT_RADIUS" if self.dest == "circle" else "DESTINATION_AREA"), None, None, "DESCRIPTIVE" if extends else "STRICT"

    def several(self, members, fact):
        return len({m[fact] for m in members if m[fact] is not None}) > 1

    def validate(self):
        """(strategy, reason), one of them null."""
        placed = [m for m in self.members if m["latitude"] is not None]
        others = [m for m in placed if m["role"] != "area"]
        one_source = self.k % 5 != 0
        if len(self.members) < len(self.hints) and self.k % 3 != 0:
            return None, "incomplete_source_composition"
        if any(m["path"] is None and m["latitude"] is None for m in self.members):
            return None, "missing_coordinates"
        if self.unit == "broken":
            return None, "EXTERNAL_AREA_SCOPE_MISMATCH"
        if self.unit == "area":
            rels = [(m, self.rel(m, self.anchor)) for m in self.members]
            if self.grant == "DEFAULT":
                passes = bool(rels) and all(r == "INSIDE" for _, r in rels)
            else:
                enters = any(m["basis"] == "LINE" and r in ("INSIDE", "INTERSECTS") for m, r in rels)
                passes = any(m["role"] != "area" for m, _ in rels) and (enters or any(m["role"] != "area" and m["basis"] != "LINE" and r == "INSIDE" for m, r in rels))
            if not passes:
                return None, "EXTERNAL_AREA_SCOPE_MISMATCH"
        if self.unit == "route":
            if not self.routes():
                return None, "EXTERNAL_ROUTE_SCOPE_MISMATCH"
            if (v := self.verdict(self.along(self.routes()[0], self.members))) != "PASSES":
                return None, v
        provenance, _, owned, _ = self.scope()
        extends = self.grant == "ROUTE_LIKE" and self.unit is None
        source = lambda ms: (None, "COMPOSITION_NOT_SUPPORTED_BY_ONE_SOURCE") if not one_source else (None, "COUNTRY_CONFLICT") if self.several(ms, "country") else ("source_defined_components", None)
        away = lambda m: sphere(m["latitude"], m["longitude"], *CIRCLE[:2]) > CIRCLE[2]
        if provenance in ("SCOPE_BEYOND_DESTINATION_NOT_AUTHORIZED", "DESTINATION_GEOGRAPHY_UNKNOWN"):
            return None, "GEOGRAPHIC_SCOPE_UNKNOWN"
        if provenance == "WORK_UNIT_ANCHOR":
            if any(not self.holds(m, self.anchor) for m in others):
                return None, "OUTSIDE_CANONICAL_AREA_BOUNDARY"
            return (None, "COUNTRY_CONFLICT") if self.several(others, "country") else ("canonical_area", None)
        if owned:
            area = provenance == "CANDIDATE_AREA"
            inner = [m for m in placed if (m["role"] != "area" if area else m["entity_id"] != owned["entity_id"])]
            if area:
                out = [m for m in inner if not self.holds(m, [line(owned["path"])])]
            else:
                found = self.along(owned, [owned, *inner])
                out = [m for m in inner if found[m["entity_id"]] not in ("ANCHOR_COMPONENT", "ON_ROUTE", "SAME_LOCAL_SCOPE")]

            def to_target(m):
                if self.dest is None or self.dest == "circle" and m["basis"] != "POINT":
                    return "UNDETERMINED"
                return ("OUTSIDE" if away(m) else "INSIDE") if self.dest == "circle" else self.rel(m, self.target)

            rels = [to_target(m) for m in out]
            if {"OUTSIDE", "UNDETERMINED"} & set(rels):
                if not extends:
                    return None, "OUTSIDE_DESTINATION_BOUNDARY" if "OUTSIDE" in rels else "GEOGRAPHIC_SCOPE_UNKNOWN"
                if not one_source:
                    return None, "COMPOSITION_NOT_SUPPORTED_BY_ONE_SOURCE"
            if self.several(inner, "country"):
                return None, "COUNTRY_CONFLICT"
            if area:
                own = {owned["region"]} if owned["region"] else {m["region"] for m in inner if m["region"] and m not in out}
                if len(own) == 1 and any(m["region"] and m["region"] not in own for m in out):
                    return None, "REGION_CONFLICT"
            return ("canonical_area" if area else "canonical_geometry"), None
        if self.dest == "circle":
            if any(map(away, placed)):
                return source(others) if extends and len(others) >= 2 else (None, "OUTSIDE_POINT_RADIUS_SCOPE")
            return "canonical_entity", None
        if len(others) < 2:
            return None, "insufficient_resolved_entities"
        if any(not within(self.target, m["longitude"], m["latitude"]) for m in others):
            return source(others) if extends else (None, "OUTSIDE_DESTINATION_BOUNDARY")
        return (None, "COUNTRY_CONFLICT") if self.several(others, "country") else ("component_defined", None)


@pytest.fixture(scope="module")
def cases(spark):
    return [Case(r.asDict(recursive=True)) for r in composed(spark, "/root/testdata/sf0.01").select("experience_id", "hints").where(F.col("experience_id") < 24000).collect()]


def test_route_membership_equals_the_twin(spark, cases):
    rows = catalog.QUERIES["op_geo_15_route_membership"](spark, "/root/testdata/sf0.01").where("experience_id < 24000").collect()
    got = {(r.experience_id, r.route_id, r.verdict, r.entity_id, r.relation) for r in rows}
    want = set()
    for c in cases:
        if c.routes():
            found = c.along(c.routes()[0], c.members)
            want |= {(c.k, c.routes()[0]["entity_id"], c.verdict(found), e, r) for e, r in found.items()}
    assert got == want and len(got) == len(rows)
    assert {w[4] for w in want} == {"ANCHOR_COMPONENT", "ON_ROUTE", "SAME_LOCAL_SCOPE", "OUTSIDE_DESTINATION", "DESTINATION_COMPATIBLE_EXTENSION", "NO_MATERIAL_ANCHOR_RELATION"}


def test_scopes_equal_the_twin(spark, cases):
    rows = catalog.QUERIES["op_geo_21_experience_scope"](spark, "/root/testdata/sf0.01").where("experience_id < 24000").collect()
    got = {r.experience_id: (r.provenance or r.reason, r.relation, r.semantics) for r in rows}
    assert got == {c.k: (s[0], s[1], s[3]) for c in cases if (s := c.scope())}
    assert {"CANDIDATE_ROUTE", "CANDIDATE_AREA", "DESTINATION_AREA", "DESTINATION_POINT_RADIUS", "DESTINATION_GEOGRAPHY_UNKNOWN", "SCOPE_BEYOND_DESTINATION_NOT_AUTHORIZED"} <= {v[0] for v in got.values()}


def test_validation_equals_the_twin(spark, cases):
    rows = catalog.QUERIES["op_geo_22_composite_validation"](spark, "/root/testdata/sf0.01").where("experience_id < 24000").collect()
    got = {r.experience_id: (r.strategy, r.reason) for r in rows}
    assert got == {c.k: c.validate() for c in cases} and all(r.accepted == (r.reason is None) for r in rows)
    reached = Counter(v for v in got.values())
    assert len(reached) >= 14, reached


def test_points_in_areas_are_not_broadcast(spark, sf):
    import contextlib
    import io

    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        catalog.QUERIES["geo_enclosing_areas"](spark, sf).explain()
    assert "SortMergeJoin" in told.getvalue() and "Broadcast" not in told.getvalue()


def test_copies_of_places_and_shapes_meet_once(spark, tmp_path, monkeypatch):
    """Suppliers whose keys differ by 14,000 share position and boundary: three of each, more than a piece of one, all pairs told."""
    import duckdb

    from wayloom.operators import areas

    met = []
    covers = areas.covers
    monkeypatch.setattr(areas, "COPIES", 2)
    monkeypatch.setattr(areas, "covers", lambda rows: met.append(rows.count()) or covers(rows))
    keys = [7 + 14_000 * k for k in range(3)] + [2007 + 14_000 * k for k in range(3)] + [k for k in range(18, 2000, 61)]
    spark.createDataFrame([(k, f"s{k}") for k in keys], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(None, "n")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES["geo_enclosing_areas"](spark, str(tmp_path)).collect()
    want = con.sql(catalog.SQL["geo_enclosing_areas"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {(7, 7), (28007, 14007), (2007, 14007)} <= set(want)
    assert met == [len({k % 14_000 for k in keys if k % 10 in (7, 8)})]
