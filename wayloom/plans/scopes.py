"""Many boundaries at once, and the geographic scope of an experience: membership along a route, derivation, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.geometry import area_relation, contains, edges, line_metres
from ..operators.areas import enclosed
from ..sources import catalog as c
from ..sources.catalog import with_
from .geometry import _EDGES, shape
from .registry import query

#: Corners of an area's boundary around its position (constants), in units of its size: a star with dents.
CORNERS = ((-1.0, -1.0), (0.0, -0.4), (1.0, -0.9), (0.5, 0.0), (0.9, 1.0), (0.1, 0.5), (-0.8, 0.9), (-0.4, 0.1))
HOLE = ((-0.15, -0.1), (0.1, -0.15), (0.2, 0.1))
_K = {"lon": "(0.004e0 * (entity_id % 7 + 1))", "lat": "(0.003e0 * (entity_id % 5 + 2))"}


def boundaries(spark, sf):
    """A boundary per area entity, one in four with a hole."""
    k = F.col("entity_id")
    a, b = F.lit(0.004) * (k % 7 + 1), F.lit(0.003) * (k % 5 + 2)
    ring = lambda corners: F.array(*[F.struct((F.col("longitude") + F.lit(i) * a).alias("x"), (F.col("latitude") + F.lit(j) * b).alias("y")) for i, j in (*corners, corners[0])])
    rings = F.when(k % 4 == 1, F.array(edges(ring(CORNERS)), edges(ring(HOLE)))).otherwise(F.array(edges(ring(CORNERS))))
    return c.geo_entity(spark, sf).where("kind = 'AREA'").select(k.alias("area_id"), rings.alias("rings"))


def _edge_sql(corners, ring):
    pairs = zip(corners, [*corners[1:], corners[0]], strict=True)
    at = lambda p, n: f"longitude + {p[0]!r}::DOUBLE * {_K['lon']} AS {n}x, latitude + {p[1]!r}::DOUBLE * {_K['lat']} AS {n}y"
    where = "kind = 'AREA'" + (" AND entity_id % 4 = 1" if ring else "")
    return " UNION ALL ".join(f"SELECT entity_id AS area_id, {ring} AS ring, {at(p, 'a')}, {at(q, 'b')} FROM geo_entity WHERE {where}" for p, q in pairs)


@query("geo_enclosing_areas", with_("geo_entity", f""", e AS ({_edge_sql(CORNERS, 0)} UNION ALL {_edge_sql(HOLE, 1)}),
odd AS (SELECT p.entity_id, e.area_id, e.ring, sum(CASE WHEN (e.by > p.latitude) <> (e.ay > p.latitude) AND p.longitude < (e.ax - e.bx) * (p.latitude - e.by) / (CASE WHEN e.ay = e.by THEN 1e0 ELSE e.ay - e.by END) + e.bx THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM geo_entity p, e GROUP BY ALL)
SELECT entity_id, area_id FROM odd GROUP BY ALL HAVING bool_or(odd AND ring = 0) AND NOT bool_or(odd AND ring = 1)""".replace("e.by", 'e."by"').replace(" AS by", ' AS "by"')))
def enclosing_areas(spark, sf):
    """All boundaries that contain each entity's position."""
    points = c.geo_entity(spark, sf).select("entity_id", "latitude", "longitude")
    return enclosed(points, boundaries(spark, sf), "entity_id")


def member_facts(spark, sf):
    """Members of compositions (the suppliers of an order, in its order) with role, shape and administrative facts: one place
    in five has a ring of its own, one in nineteen no position."""
    k, place = F.col("entity_id"), F.col("kind") == "PLACE"
    s = shape(spark, sf)
    square = F.array(*[F.struct((F.col("longitude") + F.lit(i * 0.03)).alias("x"), (F.col("latitude") + F.lit(j * 0.02)).alias("y")) for i, j in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0))])
    lost, drawn = place & (k % 19 == 3), place & (k % 5 == 2)
    basis = F.when(lost, "NONE").when(drawn, "POLYGON").otherwise(F.col("basis"))
    path = F.when(drawn & ~lost, square).otherwise(F.col("path"))
    nowhere = lambda n: F.when(~lost, F.col(n)).alias(n)
    facts = s.select(
        "entity_id", F.when(place, "waypoint").when(F.col("kind") == "ROUTE", "route").otherwise("area").alias("role"), nowhere("latitude"), nowhere("longitude"), path.alias("path"), basis.alias("basis"),
        F.when(k % 4 != 0, F.when(k % 41 == 0, "UY").otherwise("AR")).alias("country"), F.when(k % 3 != 0, F.when(k % 10 < 5, "north").otherwise("south")).alias("region"),
    )
    lines = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("experience_id"), F.col("l_suppkey").alias("entity_id")).agg(F.min("l_linenumber").alias("position"))
    state = F.when((F.col("experience_id") + F.col("entity_id")) % 13 == 0, "UNRESOLVED").otherwise("RESOLVED")
    return lines.withColumn("state", state).join(facts, "entity_id")


def _rings(area):
    edge = lambda e: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e[2:], ("ax", "ay", "bx", "by"), strict=True)])
    return F.array(*[F.array(*[edge(e) for e in _EDGES if e[:2] == (area, k)]) for k in range(3) if any(e[:2] == (area, k) for e in _EDGES)])


CIRCLE = (-34.60, -58.40, 9000.0)
NO_RINGS = "array<array<struct<ax:double,ay:double,bx:double,by:double>>>"


def composed(spark, sf):
    """One row per experience: its members in order, the destination, the work unit's authorization and anchor, and what its
    own routes and areas are. Members meet in one shuffle; the rest is projection over a bounded list."""
    k = F.col("experience_id")
    fields = ("position", "entity_id", "state", "role", "latitude", "longitude", "path", "basis", "country", "region")
    # Few bytes, but much to test of each: as many partitions as there are to be had, which the grouping keeps.
    dealt = member_facts(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "experience_id")
    rows = dealt.groupBy("experience_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("hints"))
    n = F.size("hints")
    only = F.filter("hints", lambda m: m["state"] == "RESOLVED")
    rows = rows.withColumn("members", only)
    pick = F.floor(k / 4) % 3
    grant = F.when(n < 2, "DEFAULT").when(pick == 1, "WALK").when(pick == 2, "ROUTE_LIKE").otherwise("DEFAULT")
    route = F.filter("members", lambda m: (m["role"] == "route") & (m["basis"] == "LINE"))
    unit = F.when(k % 7 == 0, "AREA").when(k % 7 == 1, "ROUTE").when(k % 7 == 2, "AREA_UNUSABLE")
    return rows.select(
        k, "hints", "members", grant.alias("grant"), unit.alias("unit"), route.alias("routes"), F.when(k % 4 == 2, "POINT_RADIUS").when(k % 4 < 2, "AREA").alias("destination"),
        F.when(k % 4 == 0, _rings(1)).when(k % 4 == 1, _rings(2)).alias("target"), F.when(k % 7 == 0, _rings(3)).alias("anchor"),
        (k % 3 == 0).alias("admitted"), (k % 5 != 0).alias("one_source"), (k % 11 != 0).alias("evidence"),
    )


def _relation(m, rings):
    return area_relation(m["basis"], m["longitude"], m["latitude"], m["path"], rings)


def _in(relation, *names):
    return relation.isin(*(names or ("INSIDE", "INTERSECTS")))


def let(value, f):
    """f of a value that is computed once, also where f uses it for every element of a list."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _placed(m):
    return m["latitude"].isNotNull() & m["longitude"].isNotNull()


def route_relations(members, route, target):
    """How each member lies to a route (entity_id, path): array of struct(entity_id, relation, metres), first rule that
    fires. target: rings of the destination or null, which is asked last and only of members with a position."""
    shared = F.filter(members, lambda a: (a["role"] == "area") & (a["basis"] == "POLYGON") & _in(area_relation(F.lit("LINE"), F.lit(0.0), F.lit(0.0), route["path"], F.array(edges(a["path"])))))

    def told(m, shared):
        own = (m["basis"] == "POLYGON") & (m["role"] != "area") & _in(area_relation(F.lit("LINE"), F.lit(0.0), F.lit(0.0), route["path"], F.array(edges(m["path"]))))
        near = F.exists(shared, lambda a: _in(_relation(m, F.array(edges(a["path"])))))
        relation = (
            F.when((m["basis"] == "NONE") & ~_placed(m), "NO_MATERIAL_ANCHOR_RELATION").when(m["entity_id"] == route["entity_id"], "ANCHOR_COMPONENT").when(own, "ON_ROUTE").when(near, "SAME_LOCAL_SCOPE")
            .when(target.isNotNull() & _placed(m) & ~contains(target, m["longitude"], m["latitude"]), "OUTSIDE_DESTINATION").otherwise("DESTINATION_COMPATIBLE_EXTENSION")
        )
        # Only a point has a distance, that of a shape's representative point would say nothing.
        point = (m["basis"] == "POINT") | (m["basis"] == "NONE") & _placed(m)
        metres = lambda r: F.when(r == "ANCHOR_COMPONENT", 0.0).when(point, line_metres(m["longitude"], m["latitude"], edges(route["path"])))
        return let(relation, lambda r: F.struct(m["entity_id"].alias("entity_id"), r.alias("relation"), metres(r).alias("metres")))

    return let(shared, lambda areas: F.transform(members, lambda m: told(m, areas)))


def route_verdict(relations):
    """PASSES, or why members don't belong to their route: none is it or on it, else one is outside the destination."""
    has = lambda *names: F.exists(relations, lambda r: r["relation"].isin(*names))
    return F.when(~has("ANCHOR_COMPONENT", "ON_ROUTE"), "NO_MATERIAL_ANCHOR_RELATION").when(has("OUTSIDE_DESTINATION"), "OUTSIDE_DESTINATION_BOUNDARY").otherwise("PASSES")


@query("op_geo_15_route_membership")
def route_membership(spark, sf):
    """Members of each experience with a route against its first one."""
    rows = composed(spark, sf).where(F.size("routes") > 0).withColumn("route", F.get("routes", F.lit(0)))
    rows = rows
    said = let(route_relations("members", F.col("route"), F.col("target")), lambda r: F.struct(r.alias("r"), route_verdict(r).alias("verdict")))
    rows = rows.select("experience_id", F.col("route.entity_id").alias("route_id"), said.alias("said")).select("experience_id", "route_id", "said.verdict", F.explode("said.r").alias("r"))
    return rows.select("experience_id", "route_id", "verdict", "r.entity_id", "r.relation", F.round("r.metres", 3).alias("metres"))


def scoped(rows):
    """composed with the derived scope: kind, provenance, relation to the destination, semantics, the owned member, extends."""
    hints = F.col("hints")
    areas = F.filter(hints, lambda h: h["role"] == "area")
    placed = F.exists(hints, lambda h: h["role"] == "waypoint")
    n_routes, n_areas = F.size("routes"), F.size(areas)
    first = F.get(areas, F.lit(0))
    drawn = (n_routes == 0) & (n_areas == 1) & placed & (first["state"] == "RESOLVED") & (first["basis"] == "POLYGON")
    rows = rows.withColumn("owned", F.when(n_routes == 1, F.get("routes", F.lit(0))).when(drawn, first))
    several = (n_routes > 1) | (n_routes == 0) & (n_areas > 1)
    target, like = F.col("target"), F.col("grant") == "ROUTE_LIKE"
    fact = lambda basis, path: F.when(target.isNull(), "UNKNOWN").otherwise(area_relation(basis, F.lit(0.0), F.lit(0.0), path, target))
    owned = F.when(F.col("owned").isNotNull(), fact(F.col("owned.basis"), F.col("owned.path")))
    rows = rows.withColumn("owned_relation", owned)
    admissible = F.col("owned").isNotNull() & (like | _in(F.col("owned_relation")))
    beyond = (F.col("unit") == "AREA") & ~several & (fact(F.lit("POLYGON"), F.transform(F.get("anchor", F.lit(0)), lambda e: F.struct(e["ax"].alias("x"), e["ay"].alias("y")))) == "OUTSIDE")
    state = (
        F.when(admissible, F.when(F.col("owned.role") == "route", "CANDIDATE_ROUTE").otherwise("CANDIDATE_AREA"))
        .when(F.col("owned_relation") == "OUTSIDE", "BEYOND").when(beyond, F.when(like, "WORK_UNIT_ANCHOR").otherwise("BEYOND"))
        .when(F.col("destination") == "POINT_RADIUS", "DESTINATION_POINT_RADIUS").when(F.col("destination") == "AREA", "DESTINATION_AREA").otherwise("NOWHERE")
    )
    rows = rows.withColumn("provenance", state).withColumn("extends", like & F.col("unit").isNull())
    kind = F.when(F.col("provenance") == "CANDIDATE_ROUTE", "ROUTE").when(F.col("provenance").isin("CANDIDATE_AREA", "WORK_UNIT_ANCHOR", "DESTINATION_AREA"), "AREA").when(F.col("provenance") == "DESTINATION_POINT_RADIUS", "POINT_RADIUS").otherwise("UNKNOWN")
    semantics = F.when(F.col("provenance") == "WORK_UNIT_ANCHOR", "STRICT").when(F.startswith(F.col("provenance"), F.lit("CANDIDATE_")), "DESCRIPTIVE").when(F.startswith(F.col("provenance"), F.lit("DESTINATION_")), F.when(F.col("extends"), "DESCRIPTIVE").otherwise("STRICT"))
    told = F.when(admissible | (F.col("owned_relation") == "OUTSIDE"), F.col("owned_relation")).when(beyond, "OUTSIDE")
    return rows.withColumns({"kind": kind, "semantics": semantics, "scope_relation": told})


@query("op_geo_21_experience_scope")
def experience_scope(spark, sf):
    """The one scope that judges an experience: its own route or area, its work unit's anchor, else the destination."""
    reason = F.when(F.col("provenance") == "BEYOND", "SCOPE_BEYOND_DESTINATION_NOT_AUTHORIZED").when(F.col("provenance") == "NOWHERE", "DESTINATION_GEOGRAPHY_UNKNOWN")
    rows = scoped(composed(spark, sf))
    return rows.select("experience_id", "kind", F.when(reason.isNull(), F.col("provenance")).alias("provenance"), reason.alias("reason"), F.col("scope_relation").alias("relation"), "semantics")


def validated(rows):
    """scoped with ``said``: struct(strategy, reason), strategy null where rejected; the first rule that fires."""
    members, target, k = F.col("members"), F.col("target"), F.lit(None).cast("string")
    n = F.size(members)
    ok = lambda strategy: F.struct(F.lit(strategy).alias("strategy"), k.alias("reason"))
    no = lambda reason: F.struct(k.alias("strategy"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    placed = F.filter(members, _placed)
    others = F.filter(placed, lambda m: m["role"] != "area")
    mixed = lambda ms, f: F.size(F.array_distinct(F.filter(F.transform(ms, lambda m: m[f]), lambda v: v.isNotNull()))) > 1
    supports = lambda m, rings: _in(_relation(m, rings), "INSIDE") | (m["basis"] == "LINE") & _in(_relation(m, rings), "INTERSECTS")

    # Composition, then the work unit's own anchor.
    complete = n == F.size("hints")
    unplaced = F.exists(members, lambda m: m["path"].isNull() & ~_placed(m))
    anchor = F.col("anchor")
    contained = F.when(F.col("grant") == "DEFAULT", (n > 0) & F.forall(members, lambda m: _relation(m, anchor) == "INSIDE")).otherwise(
        F.exists(members, lambda m: (m["role"] != "area") & (_in(_relation(m, anchor), "INSIDE") & (m["basis"] != "LINE") | (m["basis"] == "LINE") & _in(_relation(m, anchor)))) | F.exists(members, lambda m: (m["basis"] == "LINE") & _in(_relation(m, anchor))) & F.exists(members, lambda m: m["role"] != "area"))
    along = let(route_relations("members", F.get("routes", F.lit(0)), target), route_verdict)
    unit = (
        F.when((F.col("unit") == "AREA_UNUSABLE") | (F.col("unit") == "AREA") & ~contained, "EXTERNAL_AREA_SCOPE_MISMATCH")
        .when((F.col("unit") == "ROUTE") & (F.size("routes") == 0), "EXTERNAL_ROUTE_SCOPE_MISMATCH").when(F.col("unit") == "ROUTE", let(along, lambda v: F.when(v != "PASSES", v)))
    )

    # A scope of the source's own: members beyond it answer to the destination, to one source, to countries and regions.
    owned, is_area = F.col("owned"), F.col("provenance") == "CANDIDATE_AREA"
    ring = F.array(edges(owned["path"]))
    inner = F.filter(placed, lambda m: F.when(is_area, m["role"] != "area").otherwise(m["entity_id"] != owned["entity_id"]))
    asked = F.when(is_area | ~_placed(owned), inner).otherwise(F.concat(F.array(owned), inner))
    tied = lambda m, facts: F.exists(F.filter(facts, lambda r: r["entity_id"] == m["entity_id"]), lambda r: r["relation"].isin("ANCHOR_COMPONENT", "ON_ROUTE", "SAME_LOCAL_SCOPE"))
    to_target = lambda m: (
        F.when(F.col("destination").isNull(), "UNDETERMINED")
        .when(F.col("destination") == "POINT_RADIUS", F.when(m["basis"] != "POINT", "UNDETERMINED").when(haversine_m(m["latitude"], m["longitude"], F.lit(CIRCLE[0]), F.lit(CIRCLE[1])) <= CIRCLE[2], "INSIDE").otherwise("OUTSIDE"))
        .otherwise(_relation(m, target)))
    regions = lambda ms: F.array_distinct(F.filter(F.transform(ms, lambda m: m["region"]), lambda v: v.isNotNull()))
    own_region = F.when(owned["region"].isNotNull(), F.array(owned["region"])).otherwise(regions(F.filter(inner, lambda m: supports(m, ring))))

    def judged(outside, rel):
        beyond = F.exists(rel, lambda r: r.isin("OUTSIDE", "UNDETERMINED"))
        contrary = let(own_region, lambda own: is_area & (F.size(own) == 1) & F.exists(outside, lambda m: m["region"].isNotNull() & (m["region"] != F.get(own, F.lit(0)))))
        return (
            F.when(beyond & ~F.col("extends"), F.when(F.exists(rel, lambda r: r == "OUTSIDE"), no("OUTSIDE_DESTINATION_BOUNDARY")).otherwise(no("GEOGRAPHIC_SCOPE_UNKNOWN")))
            .when(beyond & ~F.col("one_source"), no("COMPOSITION_NOT_SUPPORTED_BY_ONE_SOURCE")).when(mixed(inner, "country"), no("COUNTRY_CONFLICT")).when(contrary, no("REGION_CONFLICT"))
            .otherwise(F.when(is_area, ok("canonical_area")).otherwise(ok("canonical_geometry")))
        )

    beyond_area = F.filter(inner, lambda m: ~supports(m, ring))
    beyond_route = let(route_relations(asked, owned, target), lambda facts: F.filter(inner, lambda m: ~tied(m, facts)))
    descriptive = let(F.when(is_area, beyond_area).otherwise(beyond_route), lambda out: let(F.transform(out, to_target), lambda rel: judged(out, rel)))
    strict = F.when(F.exists(others, lambda m: ~supports(m, anchor)), no("OUTSIDE_CANONICAL_AREA_BOUNDARY")).when(mixed(others, "country"), no("COUNTRY_CONFLICT")).otherwise(ok("canonical_area"))
    source = lambda ms: F.when(~F.col("one_source"), no("COMPOSITION_NOT_SUPPORTED_BY_ONE_SOURCE")).when(mixed(ms, "country"), no("COUNTRY_CONFLICT")).otherwise(ok("source_defined_components"))
    within = lambda m: contains(target, m["longitude"], m["latitude"])
    local = (
        F.when(F.size(others) < 2, no("insufficient_resolved_entities"))
        .when(F.exists(others, lambda m: ~within(m)), F.when(F.col("extends"), source(others)).otherwise(no("OUTSIDE_DESTINATION_BOUNDARY")))
        .when(mixed(others, "country"), no("COUNTRY_CONFLICT")).otherwise(ok("component_defined"))
    )
    far = F.exists(placed, lambda m: haversine_m(m["latitude"], m["longitude"], F.lit(CIRCLE[0]), F.lit(CIRCLE[1])) > CIRCLE[2])
    radius = F.when(far, F.when(F.col("extends") & (F.size(others) >= 2), source(others)).otherwise(no("OUTSIDE_POINT_RADIUS_SCOPE"))).otherwise(ok("canonical_entity"))
    by_scope = (
        F.when(F.col("kind") == "UNKNOWN", no("GEOGRAPHIC_SCOPE_UNKNOWN")).when(F.col("provenance") == "WORK_UNIT_ANCHOR", strict).when(F.startswith(F.col("provenance"), F.lit("CANDIDATE_")), descriptive)
        .when(F.col("kind") == "AREA", local).otherwise(radius)
    )
    of_unit = let(unit, lambda u: F.when(u.isNotNull(), no(u)).otherwise(by_scope))
    said = F.when(~complete & ~F.col("admitted"), no("incomplete_source_composition")).when(unplaced, no("missing_coordinates")).otherwise(of_unit)
    return rows.withColumn("said", said)


@query("op_geo_22_composite_validation")
def composite_validation(spark, sf):
    """Whether the geography of each composition holds, by which strategy or against which reason."""
    return validated(scoped(composed(spark, sf))).select("experience_id", F.col("said.strategy").isNotNull().alias("accepted"), "said.strategy", "said.reason", "provenance")
