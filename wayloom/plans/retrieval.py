"""Retrieval: radius search, nearest matches, memberships, vector similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import bbox, haversine_m, haversine_sql, in_polygon
from ..operators.spatial import geodesic_join, in_cells, near_pairs, nearest_match, over_cells, radius_join, scoped_experiences
from ..operators.vectors import cosine_to
from ..sources import catalog as c
from ..sources.catalog import with_
from .registry import query

_SCOPED = f"""scoped AS (SELECT r.request_id, m.experience_id, min({haversine_sql('r.latitude', 'r.longitude', 'g.latitude', 'g.longitude')}) AS distance_m
  FROM request r, geo_entity g JOIN component m USING (entity_id) JOIN experience e USING (experience_id)
  WHERE m.state = 'RESOLVED' AND e.status = 'VERIFIED' AND {haversine_sql('r.latitude', 'r.longitude', 'g.latitude', 'g.longitude')} <= r.radius_m GROUP BY ALL)"""


def _scoped(spark, sf):
    return scoped_experiences(c.request(spark), c.experience(spark, sf), c.resolved_member(spark, sf), c.geo_entity(spark, sf))


@query("op_join_01_radius_min_distance", with_("geo_entity experience component request", f", {_SCOPED} SELECT request_id, experience_id, round(distance_m, 4) AS distance_m FROM scoped"))
def radius_min_distance(spark, sf):
    return _scoped(spark, sf).select("request_id", "experience_id", F.round("distance_m", 4).alias("distance_m"))


@query("op_top_09_nearest_page", with_("geo_entity experience component request", f", {_SCOPED} SELECT request_id, rank, experience_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance_m, experience_id) AS INTEGER) AS rank FROM scoped) WHERE rank <= 100"))
def nearest_page(spark, sf):
    order = Window.partitionBy("request_id").orderBy("distance_m", "experience_id")
    return _scoped(spark, sf).withColumn("rank", F.row_number().over(order)).where("rank <= 100").select("request_id", "rank", "experience_id")


_FLAGSHIP = f""", {_SCOPED}, wanted AS (SELECT r.request_id, f.experience_id FROM request r JOIN facet f ON f.facet = r.theme AND f.dimension = 'theme'),
scored AS (SELECT s.request_id, s.experience_id, s.distance_m, coalesce(e.quality, 0e0) / 5e0 * 5e-1 + CASE WHEN w.experience_id IS NULL THEN 0e0 ELSE 1e0 END AS score
  FROM scoped s JOIN experience e USING (experience_id) LEFT JOIN wanted w USING (request_id, experience_id))
SELECT request_id, rank, experience_id, round(score, 6) AS score, round(distance_m, 4) AS distance_m
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, experience_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 20"""


@query("geo_radius_catalog", with_("geo_entity experience component facet request", _FLAGSHIP))
def geo_radius_catalog(spark, sf):
    """Best experiences near each request: radius scope, quality, facet match, relevance order."""
    wanted = c.request(spark).join(c.facet(spark, sf).where("dimension = 'theme'"), F.col("theme") == F.col("facet")).select("request_id", "experience_id", F.lit(1.0).alias("match"))
    scored = _scoped(spark, sf).join(c.experience(spark, sf).select("experience_id", "quality"), "experience_id").join(wanted, ["request_id", "experience_id"], "left")
    scored = scored.withColumn("score", F.round(F.coalesce("quality", F.lit(0.0)) / 5.0 * 0.5 + F.coalesce("match", F.lit(0.0)), 6))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "experience_id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("request_id", "rank", "experience_id", "score", F.round("distance_m", 4).alias("distance_m"))


@query("op_geo_03_geodesic_radius")
def geodesic_radius(spark, sf):
    """The live radius search: verified experiences of which a resolved member lies within the radius on the ellipsoid, with
    the least distance, nearest first."""
    asked = c.request(spark).select("request_id", "latitude", "longitude", "radius_m")
    near = geodesic_join(asked, c.geo_entity(spark, sf).select("entity_id", "latitude", "longitude")).select("request_id", "entity_id", "distance_m")
    scoped = c.resolved_member(spark, sf).join(near, "entity_id").groupBy("request_id", "experience_id").agg(F.min("distance_m").alias("distance_m"))
    scoped = scoped.join(c.experience(spark, sf).where("status = 'VERIFIED'").select("experience_id"), "experience_id", "left_semi")
    order = Window.partitionBy("request_id").orderBy("distance_m", "experience_id")
    return scoped.select("request_id", F.row_number().over(order).alias("rank"), "experience_id", F.round("distance_m", 4).alias("distance_m"))


@query("op_join_04_nearest_match", with_("geo_entity", f"""SELECT left_id, right_id, round(d, 4) AS distance_m FROM (
  SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d, right_id) AS n FROM (
    SELECT a.entity_id AS left_id, b.entity_id AS right_id, {haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS d
    FROM geo_entity a JOIN geo_entity b ON a.kind = b.kind AND a.entity_id < 1000003 AND b.entity_id >= 1000003
    AND b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01 AND b.longitude BETWEEN a.longitude - 0.02 AND a.longitude + 0.02) WHERE d <= 150) WHERE n = 1"""))
def nearest(spark, sf):
    g = c.geo_entity(spark, sf).select("entity_id", "latitude", "longitude", "kind")
    out = nearest_match(g.where("entity_id < 1000003"), g.where("entity_id >= 1000003"), 150.0, "entity_id", "entity_id", ("kind",))
    return out.select(F.col("_a").alias("left_id"), F.col("_b").alias("right_id"), F.round("distance_m", 4).alias("distance_m"))


@query("op_join_06_overlap_pairs", with_("geo_entity", f"""SELECT a.entity_id AS left_id, b.entity_id AS right_id FROM geo_entity a JOIN geo_entity b ON a.entity_id < b.entity_id
  AND b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01 AND b.longitude BETWEEN a.longitude - 0.02 AND a.longitude + 0.02
  WHERE {haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 150"""))
def overlap_pairs(spark, sf):
    g = c.geo_entity(spark, sf)
    return near_pairs(g, g, 150.0, "entity_id", "entity_id").where("_a < _b").select(F.col("_a").alias("left_id"), F.col("_b").alias("right_id"))


@query("op_flt_02_bbox", with_("geo_entity request", """SELECT request_id, entity_id FROM request r JOIN geo_entity g
  ON abs(g.latitude - r.latitude) <= r.radius_m / 111320e0 AND abs(g.longitude - r.longitude) <= r.radius_m / (111320e0 * greatest(cos(radians(r.latitude)), 1e-2))"""))
def box_filter(spark, sf):
    r = c.request(spark).select("request_id", "latitude", "longitude", "radius_m")
    dy, dx = bbox(F.col("latitude"), F.col("longitude"), F.col("radius_m"))
    boxes = over_cells(r, dy, dx).select("request_id", "_y", "_x", F.col("latitude").alias("la"), F.col("longitude").alias("lo"), dy.alias("dy"), dx.alias("dx"))
    met = in_cells(c.geo_entity(spark, sf)).join(boxes, ["_y", "_x"])
    return met.where((F.abs(F.col("latitude") - F.col("la")) <= F.col("dy")) & (F.abs(F.col("longitude") - F.col("lo")) <= F.col("dx"))).select("request_id", "entity_id")


#: A polygon with a hole, as rings of (latitude, longitude).
AREA = [[(-34.66, -58.46), (-34.66, -58.36), (-34.60, -58.32), (-34.55, -58.38), (-34.58, -58.47)], [(-34.62, -58.42), (-34.62, -58.40), (-34.60, -58.40), (-34.60, -58.42)]]


def _ring_sql(ring):
    tests = []
    for (a, b), (cc, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
        tests.append(f"CASE WHEN (({a!r}::DOUBLE > latitude) <> ({cc!r}::DOUBLE > latitude)) AND longitude < {d - b!r}::DOUBLE * (latitude - {a!r}::DOUBLE) / {(cc - a if cc != a else 1.0)!r}::DOUBLE + {b!r}::DOUBLE THEN 1 ELSE 0 END")
    return f"(({' + '.join(tests)}) % 2 = 1)"


@query("op_geo_06_point_in_polygon", with_("geo_entity", f"SELECT entity_id, {_ring_sql(AREA[0])} AND NOT {_ring_sql(AREA[1])} AS inside FROM geo_entity"))
def point_in_polygon(spark, sf):
    return c.geo_entity(spark, sf).select("entity_id", in_polygon(F.col("latitude"), F.col("longitude"), AREA).alias("inside"))


@query("op_join_11_area_containment", with_("geo_entity", f""", b(area_id, lo_lat, hi_lat, lo_lon, hi_lon) AS (VALUES (1, -34.66::DOUBLE, -34.58::DOUBLE, -58.46::DOUBLE, -58.38::DOUBLE), (2, -34.62::DOUBLE, -34.54::DOUBLE, -58.42::DOUBLE, -58.34::DOUBLE))
SELECT entity_id, CASE count(area_id) WHEN 0 THEN 'OUTSIDE' WHEN 1 THEN 'INSIDE' ELSE 'AMBIGUOUS' END AS membership FROM geo_entity LEFT JOIN b ON latitude BETWEEN lo_lat AND hi_lat AND longitude BETWEEN lo_lon AND hi_lon GROUP BY entity_id"""))
def area_containment(spark, sf):
    areas = [(1, -34.66, -34.58, -58.46, -58.38), (2, -34.62, -34.54, -58.42, -58.34)]
    hits = sum((F.when(F.col("latitude").between(a, b) & F.col("longitude").between(x, y), 1).otherwise(0) for _, a, b, x, y in areas), F.lit(0))
    return c.geo_entity(spark, sf).select("entity_id", F.when(hits == 0, "OUTSIDE").when(hits == 1, "INSIDE").otherwise("AMBIGUOUS").alias("membership"))


@query("op_agg_12_bbox_centroid", with_("geo_entity component", """SELECT experience_id, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon, min(latitude) AS lo_lat, max(latitude) AS hi_lat, min(longitude) AS lo_lon, max(longitude) AS hi_lon, count(*) AS members
  FROM component JOIN geo_entity USING (entity_id) WHERE state = 'RESOLVED' GROUP BY 1"""))
def centroid(spark, sf):
    m = c.component(spark, sf).where("state = 'RESOLVED'").join(c.geo_entity(spark, sf), "entity_id")
    return m.groupBy("experience_id").agg(F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon"), F.min("latitude").alias("lo_lat"), F.max("latitude").alias("hi_lat"), F.min("longitude").alias("lo_lon"), F.max("longitude").alias("hi_lon"), F.count("*").alias("members"))


@query("op_geo_05_distance_score", with_("geo_entity request", f"""SELECT request_id, entity_id, round(greatest(0e0, 1e2 * (1e0 - d / radius_m)), 4) AS score,
  CASE WHEN d < 1000 THEN CAST(CAST(floor(d + 5e-1) AS BIGINT) AS VARCHAR) || ' m' ELSE CAST(CAST(floor(d / 1e3 + 5e-1) AS BIGINT) AS VARCHAR) || ' km' END AS label
  FROM (SELECT request_id, entity_id, radius_m, {haversine_sql('r.latitude', 'r.longitude', 'g.latitude', 'g.longitude')} AS d FROM request r, geo_entity g) WHERE d <= radius_m"""))
def distance_score(spark, sf):
    near = radius_join(c.request(spark).select("request_id", "latitude", "longitude", "radius_m"), c.geo_entity(spark, sf).select("entity_id", "latitude", "longitude"))
    d = F.col("distance_m")
    label = F.when(d < 1000, F.concat(F.floor(d + 0.5).cast("string"), F.lit(" m"))).otherwise(F.concat(F.floor(d / 1e3 + 0.5).cast("string"), F.lit(" km")))
    return near.select("request_id", "entity_id", F.round(F.greatest(F.lit(0.0), F.lit(100.0) * (1 - d / F.col("radius_m"))), 4).alias("score"), label.alias("label"))


@query("op_math_11_cosine_topk", """SELECT vec_id, rank, round(s, 6) AS similarity FROM (SELECT e.vec_id, s, CAST(row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 1) e) WHERE rank <= 20""")
def cosine_topk(spark, sf):
    e = c.read(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").limit(1).collect()
    s = cosine_to(F.col("embedding"), q[0][0] if q else [])
    order = Window.orderBy(F.desc(F.round("s", 9)), "vec_id")
    top = e.where("label = 1").select("vec_id", s.alias("s")).orderBy(F.desc(F.round("s", 9)), "vec_id").limit(20)
    return top.select("vec_id", F.row_number().over(order).alias("rank"), F.round("s", 6).alias("similarity"))


@query("op_rank_01_similarity_by_identity", """WITH ids AS (SELECT p_partkey AS vec_id FROM part)
SELECT ids.vec_id, CASE WHEN e.label = 1 THEN 'applied' ELSE 'unavailable' END AS status, CASE WHEN e.label = 1 THEN round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) END AS similarity
FROM ids LEFT JOIN embeddings e USING (vec_id) CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q""")
def similarity_by_identity(spark, sf):
    e = c.read(spark, sf, "embeddings")
    ids = c.read(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"))
    q = e.where("vec_id = 0").select("embedding").limit(1).collect()
    joined = ids.join(e, "vec_id", "left")
    return joined.select("vec_id", F.when(F.col("label") == 1, "applied").otherwise("unavailable").alias("status"), F.when(F.col("label") == 1, F.round(cosine_to(F.col("embedding"), q[0][0] if q else []), 6)).alias("similarity"))


@query("op_flt_10_stale_embeddings", "SELECT vec_id FROM embeddings WHERE label IS NULL OR label <> vec_id % 10 OR len(embedding) <> 64")
def stale_embeddings(spark, sf):
    e = c.read(spark, sf, "embeddings")
    same = F.struct("label", F.size("embedding")).eqNullSafe(F.struct((F.col("vec_id") % 10).cast("int").alias("label"), F.lit(64)))
    return e.where(~same).select("vec_id")
