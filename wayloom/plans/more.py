"""Further operators: projections, sinks as last-wins rows, sets, texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, in_polygon
from ..operators.text import atomize, coverage
from ..sources import catalog as c
from ..sources.catalog import with_
from .registry import query
from .retrieval import AREA, _ring_sql


@query("op_src_04_row_projection", with_("experience component geo_entity", """SELECT e.experience_id, e.name, count(g.entity_id) AS members, round(avg(g.latitude), 6) AS latitude FROM experience e LEFT JOIN component m ON m.experience_id = e.experience_id AND m.state = 'RESOLVED' LEFT JOIN geo_entity g ON g.entity_id = m.entity_id GROUP BY 1, 2"""))
def row_projection(spark, sf):
    m = c.component(spark, sf).where("state = 'RESOLVED'").join(c.geo_entity(spark, sf).select("entity_id", "latitude"), "entity_id")
    sums = m.groupBy("experience_id").agg(F.count("*").alias("members"), F.round(F.avg("latitude"), 6).alias("latitude"))
    return c.experience(spark, sf).select("experience_id", "name").join(sums, "experience_id", "left").select("experience_id", "name", F.coalesce("members", F.lit(0)).alias("members"), "latitude")


@query("op_src_05_detail", with_("experience component", "SELECT e.experience_id, e.price, string_agg(CAST(m.entity_id AS VARCHAR), ',' ORDER BY m.position) AS unresolved FROM experience e JOIN component m USING (experience_id) WHERE m.state = 'UNRESOLVED' GROUP BY 1, 2"))
def detail(spark, sf):
    e = c.experience(spark, sf).select("experience_id", "price")
    m = e.join(c.component(spark, sf).where("state = 'UNRESOLVED'"), "experience_id").groupBy("experience_id", "price").agg(F.sort_array(F.collect_list(F.struct("position", "entity_id"))).alias("x"))
    return m.select("experience_id", "price", F.array_join(F.transform("x", lambda r: r["entity_id"].cast("string")), ",").alias("unresolved"))


@query("op_src_20_plan_coalescing", "SELECT event_type AS provider, string_agg(DISTINCT CAST(user_id % 10 AS VARCHAR), ',' ORDER BY CAST(user_id % 10 AS VARCHAR)) AS routes FROM events GROUP BY 1")
def plan_coalescing(spark, sf):
    return c.read(spark, sf, "events").groupBy(F.col("event_type").alias("provider")).agg(F.array_join(F.sort_array(F.collect_set((F.col("user_id") % 10).cast("string"))), ",").alias("routes"))


@query("op_src_21_fingerprint_ledger", "SELECT key, min(o_orderkey) AS first FROM (SELECT o_orderkey, sha256(trim(lower(o_orderpriority)) || '|' || o_orderstatus || '|' || CAST(o_custkey % 100 AS VARCHAR)) AS key FROM orders) GROUP BY 1")
def fingerprint_ledger(spark, sf):
    key = F.sha2(F.concat_ws("|", F.trim(F.lower("o_orderpriority")), "o_orderstatus", (F.col("o_custkey") % 100).cast("string")), 256)
    return c.read(spark, sf, "orders").select(key.alias("key"), "o_orderkey").groupBy("key").agg(F.min("o_orderkey").alias("first"))


@query("op_src_24_media_upsert", "SELECT l_partkey, l_suppkey, price FROM (SELECT l_partkey, l_suppkey, l_extendedprice AS price, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def media_upsert(spark, sf):
    newest = F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"))
    return c.read(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(newest.alias("price"))


@query("op_src_25_embedding_write_back", "SELECT e.vec_id, CASE WHEN e.label <> e.vec_id % 10 THEN 'REWRITTEN' ELSE 'KEPT' END AS outcome FROM embeddings e WHERE len(embedding) = 64")
def write_back(spark, sf):
    e = c.read(spark, sf, "embeddings").where(F.size("embedding") == 64)
    return e.select("vec_id", F.when(F.col("label") != F.col("vec_id") % 10, "REWRITTEN").otherwise("KEPT").alias("outcome"))


@query("op_flt_12_within_destination", with_("geo_entity", f"SELECT entity_id FROM geo_entity WHERE kind = 'PLACE' AND {_ring_sql(AREA[0])} AND NOT {_ring_sql(AREA[1])}"))
def within_destination(spark, sf):
    return c.geo_entity(spark, sf).where("kind = 'PLACE'").where(in_polygon(F.col("latitude"), F.col("longitude"), AREA)).select("entity_id")


@query("op_flt_15_scale_eligible", "SELECT s_suppkey, CASE WHEN rank BETWEEN 13 AND 25 THEN 'AREA' WHEN rank >= 26 THEN 'POINT' ELSE 'NOT_ELIGIBLE' END AS scale FROM (SELECT s_suppkey, s_suppkey % 31 AS rank FROM supplier)")
def scale_eligible(spark, sf):
    rank = F.col("s_suppkey") % 31
    return c.read(spark, sf, "supplier").select("s_suppkey", F.when(rank.between(13, 25), "AREA").when(rank >= 26, "POINT").otherwise("NOT_ELIGIBLE").alias("scale"))


@query("op_join_03_composites_in_area", with_("geo_entity component", f", i AS (SELECT entity_id FROM geo_entity WHERE {_ring_sql(AREA[0])} AND NOT {_ring_sql(AREA[1])}) SELECT experience_id, count(*) AS inside FROM component JOIN i USING (entity_id) WHERE state = 'RESOLVED' GROUP BY 1 HAVING count(*) >= 2"))
def composites_in_area(spark, sf):
    lows, highs = [min(p[k] for p in AREA[0]) for k in (0, 1)], [max(p[k] for p in AREA[0]) for k in (0, 1)]
    boxed = c.geo_entity(spark, sf).where(F.col("latitude").between(lows[0], highs[0]) & F.col("longitude").between(lows[1], highs[1]))
    inside = boxed.where(in_polygon(F.col("latitude"), F.col("longitude"), AREA)).select("entity_id")
    return c.component(spark, sf).where("state = 'RESOLVED'").join(inside, "entity_id").groupBy("experience_id").agg(F.count("*").alias("inside")).where("inside >= 2")


@query("op_join_07_pairwise_proposals", "SELECT a.p_brand, a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def pairwise_proposals(spark, sf):
    p = c.read(spark, sf, "part").select("p_brand", "p_size", "p_type", "p_partkey")
    keys = ["p_brand", "p_size", "p_type"]
    return p.withColumnRenamed("p_partkey", "left_id").join(p.withColumnRenamed("p_partkey", "right_id"), keys).where("left_id < right_id").select("p_brand", "left_id", "right_id")


@query("op_join_12_distinct_fan_out", with_("experience", "SELECT l_orderkey AS tour, any_value(o_custkey) AS owner FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN experience ON experience_id = l_partkey WHERE status = 'DRAFT' GROUP BY 1"))
def distinct_fan_out(spark, sf):
    """Tours that touch an experience whose status changed, each once, with their owner."""
    changed = c.experience(spark, sf).where("status = 'DRAFT'").select(F.col("experience_id").alias("l_partkey"))
    tours = c.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey").join(changed, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("tour")).distinct()
    return tours.join(c.read(spark, sf, "orders"), F.col("tour") == F.col("o_orderkey")).select("tour", F.col("o_custkey").alias("owner"))


@query("op_agg_13_multiplicity", "SELECT c_custkey, CASE count(o_orderkey) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'SINGLE' ELSE 'MULTIPLE' END AS multiplicity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def multiplicity(spark, sf):
    n = c.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    found = c.read(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return found.select("c_custkey", F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") == 1, "SINGLE").otherwise("MULTIPLE").alias("multiplicity"))


@query("op_agg_17_provider_counts", "SELECT l_returnflag AS provider, count(*) AS legs, count(*) FILTER (l_linestatus = 'F') AS fallbacks FROM lineitem GROUP BY 1")
def provider_counts(spark, sf):
    return c.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg(F.count("*").alias("legs"), F.count_if(F.col("l_linestatus") == "F").alias("fallbacks"))


@query("op_win_05_nearest_else_importance", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN o_totalprice END ASC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def nearest_else_importance(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), F.desc("o_orderkey"))
    return c.read(spark, sf, "orders").withColumn("n", F.row_number().over(order)).where("n = 1").select("o_custkey", "o_orderkey")


@query("op_top_03_offset_pagination", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def offset_pagination(spark, sf):
    return c.read(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey")


@query("op_top_08_best_unit", "SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS unit FROM lineitem GROUP BY 1")
def best_unit(spark, sf):
    return c.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("unit"))


@query("op_set_06_evidence_dedupe", "SELECT DISTINCT l_returnflag || '|' || l_linestatus || '|' || CAST(l_suppkey AS VARCHAR) AS evidence FROM lineitem")
def evidence_dedupe(spark, sf):
    return c.read(spark, sf, "lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")).alias("evidence")).distinct()


@query("op_geo_16_covering_circle", with_("geo_entity component", """, b AS (SELECT experience_id, (min(latitude) + max(latitude)) / 2 AS la, (min(longitude) + max(longitude)) / 2 AS lo FROM component JOIN geo_entity USING (entity_id) GROUP BY 1)
SELECT experience_id, round(la, 6) AS latitude, round(lo, 6) AS longitude, round(max(sqrt(pow((latitude - la) * 111320e0, 2) + pow((longitude - lo) * 111320e0 * cos(radians(la)), 2))), 3) AS radius_m FROM b JOIN component USING (experience_id) JOIN geo_entity USING (entity_id) GROUP BY experience_id, la, lo"""))
def covering_circle(spark, sf):
    m = c.component(spark, sf).join(c.geo_entity(spark, sf), "entity_id").select("experience_id", "latitude", "longitude")
    b = m.groupBy("experience_id").agg(((F.min("latitude") + F.max("latitude")) / 2).alias("la"), ((F.min("longitude") + F.max("longitude")) / 2).alias("lo"))
    dy, dx = (F.col("latitude") - F.col("la")) * METRES_PER_DEGREE, (F.col("longitude") - F.col("lo")) * METRES_PER_DEGREE * F.cos(F.radians("la"))
    g = m.join(b, "experience_id").groupBy("experience_id", "la", "lo").agg(F.round(F.max(F.sqrt(dy * dy + dx * dx)), 3).alias("radius_m"))
    return g.select("experience_id", F.round("la", 6).alias("latitude"), F.round("lo", 6).alias("longitude"), "radius_m")


@query("op_geo_17_circle_polygon", with_("request", """SELECT request_id, CAST(k AS INTEGER) AS corner, round(latitude + radius_m * sin(2e0 * pi() * k / 32) / 111320e0, 6) AS la, round(longitude + radius_m * cos(2e0 * pi() * k / 32) / (111320e0 * greatest(cos(radians(latitude)), 1e-1)), 6) AS lo FROM request, range(0, 33) t(k)"""))
def circle_polygon(spark, sf):
    r = c.request(spark).withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(32))))
    turn = 2.0 * F.pi() * F.col("corner") / 32
    la = F.col("latitude") + F.col("radius_m") * F.sin(turn) / METRES_PER_DEGREE
    lo = F.col("longitude") + F.col("radius_m") * F.cos(turn) / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians("latitude")), F.lit(0.1)))
    return r.select("request_id", "corner", F.round(la, 6).alias("la"), F.round(lo, 6).alias("lo"))


@query("op_er_06_order_conflict", """WITH s AS (SELECT o_custkey AS owner, l_orderkey AS k, l_suppkey AS m, min(l_linenumber) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), j AS (SELECT a.k, b.k AS other, a.m, a.pos AS x, b.pos AS y FROM s a JOIN s b ON a.owner = b.owner AND a.m = b.m AND a.k < b.k)
SELECT k AS left_id, other AS right_id, count(*) FILTER (y < before) > 0 AS conflict FROM (SELECT *, lag(y) OVER (PARTITION BY k, other ORDER BY x, m) AS before FROM j) GROUP BY 1, 2""")
def order_conflict(spark, sf):
    """Tours of one owner that share members: whether these stand in another order."""
    owned = c.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("owner"))
    s = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("m")).agg(F.min("l_linenumber").alias("x")).join(owned, "k")
    j = s.join(s.select(F.col("k").alias("other"), "owner", "m", F.col("x").alias("y")), ["owner", "m"]).where("k < other")
    before = F.lag("y").over(Window.partitionBy("k", "other").orderBy("x", "m"))
    return j.withColumn("before", before).groupBy(F.col("k").alias("left_id"), F.col("other").alias("right_id")).agg((F.count_if(F.col("y") < F.col("before")) > 0).alias("conflict"))


@query("op_er_08_standalone_vs_composite", with_("component", "SELECT experience_id, CASE WHEN count(DISTINCT entity_id) = 1 THEN 'STANDALONE' ELSE 'COMPOSITE' END AS form FROM component WHERE state = 'RESOLVED' GROUP BY 1"))
def standalone_vs_composite(spark, sf):
    n = c.component(spark, sf).where("state = 'RESOLVED'").groupBy("experience_id").agg(F.count_distinct("entity_id").alias("n"))
    return n.select("experience_id", F.when(F.col("n") == 1, "STANDALONE").otherwise("COMPOSITE").alias("form"))


@query("op_txt_01_atomization")
def atomization(spark, sf):
    return atomize(c.read(spark, sf, "documents"))


@query("op_txt_02_coverage", "SELECT doc_id, true AS covered, CAST(0 AS BIGINT) AS overlaps FROM documents")
def covered(spark, sf):
    docs = c.read(spark, sf, "documents")
    return coverage(docs, atomize(docs))


@query("op_txt_05_batch_packing", """WITH x AS (SELECT doc_id, CAST(floor(coalesce(sum(n_chars) OVER (PARTITION BY lang, doc_id // 1000 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2500) AS BIGINT) AS batch FROM documents) SELECT doc_id, batch FROM x""")
def batch_packing(spark, sf):
    before = Window.partitionBy("lang", F.floor(F.col("doc_id") / 1000)).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return c.read(spark, sf, "documents").select("doc_id", F.floor(F.coalesce(F.sum("n_chars").over(before), F.lit(0)) / 2500).alias("batch"))


@query("op_txt_13_failure_class", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'RETRYABLE' WHEN event_type = 'error' THEN 'TERMINAL' ELSE 'NONE' END AS class FROM events")
def failure_class(spark, sf):
    bad = F.col("event_type") == "error"
    return c.read(spark, sf, "events").select("event_id", F.when(bad & (F.col("value") > 50), "RETRYABLE").when(bad, "TERMINAL").otherwise("NONE").alias("class"))
