"""Filters, aggregates, windows, top-k and set operations over the base and derived tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quality import FLOOR, valid_quality
from ..sources import catalog as c
from ..sources.catalog import with_
from .registry import query


@query("op_src_01_lookup_in_order", with_("experience", """, ids AS (SELECT CAST(i * 37 % 900 + 1 AS BIGINT) AS experience_id, CAST(i AS INTEGER) AS pos FROM range(0, 60) t(i))
SELECT pos, experience_id, name FROM ids JOIN experience USING (experience_id) WHERE status = 'VERIFIED'"""))
def lookup_in_order(spark, sf):
    ids = spark.range(60).select((F.col("id") * 37 % 900 + 1).alias("experience_id"), F.col("id").cast("int").alias("pos"))
    return ids.join(c.experience(spark, sf).where("status = 'VERIFIED'"), "experience_id").select("pos", "experience_id", "name")


@query("op_src_03_nested_children", with_("component", """SELECT experience_id, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY position) AS members, count(*) FILTER (state = 'RESOLVED') AS resolved FROM component GROUP BY 1"""))
def nested_children(spark, sf):
    g = c.component(spark, sf).groupBy("experience_id").agg(F.sort_array(F.collect_list(F.struct("position", "entity_id"))).alias("m"), F.count_if(F.col("state") == "RESOLVED").alias("resolved"))
    return g.select("experience_id", F.array_join(F.transform("m", lambda x: x["entity_id"].cast("string")), ",").alias("members"), "resolved")


@query("op_src_07_latest_page_wins", """SELECT l_orderkey AS feature, page, l_partkey AS part FROM (SELECT *, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def latest_page_wins(spark, sf):
    best = c.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct(F.col("l_linenumber").alias("page"), (-F.col("l_partkey")).alias("p"))).alias("x"))
    return best.select(F.col("l_orderkey").alias("feature"), F.col("x.page").alias("page"), (-F.col("x.p")).alias("part"))


@query("op_src_10_name_multiplicity", """SELECT s_name AS name, 'SINGLE' AS multiplicity, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) = 1 UNION ALL SELECT s_name, 'MULTIPLE', count(*) FROM supplier GROUP BY 1 HAVING count(*) > 1""")
def name_multiplicity(spark, sf):
    n = c.read(spark, sf, "supplier").groupBy(F.col("s_name").alias("name")).agg(F.count("*").alias("n"))
    return n.select("name", F.when(F.col("n") == 1, "SINGLE").otherwise("MULTIPLE").alias("multiplicity"), "n")


@query("op_src_16_cache_key", """SELECT o_orderkey, sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS key FROM orders""")
def cache_key(spark, sf):
    o = c.read(spark, sf, "orders")
    canonical = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return o.select("o_orderkey", F.sha2(canonical, 256).alias("key"))


@query("op_src_17_negative_cache", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '2001-07-25')""")
def negative_cache(spark, sf):
    live = c.read(spark, sf, "orders").where(F.col("o_orderdate") + F.expr("interval 30 days") > F.lit("2001-07-25").cast("timestamp"))
    return c.read(spark, sf, "customer").join(live, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("op_src_18_category_anchor_plan", """SELECT CAST(row_number() OVER (ORDER BY (cat - anchor + 5) % 5, anchor) AS INTEGER) AS call, anchor, cat FROM range(0, 4) a(anchor), range(0, 5) k(cat) ORDER BY (cat - anchor + 5) % 5, anchor LIMIT 12""")
def category_anchor_plan(spark, sf):
    grid = spark.range(4).select(F.col("id").alias("anchor"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("cat"))
    order = ((F.col("cat") - F.col("anchor") + 5) % 5, F.col("anchor"))
    return grid.orderBy(*order).limit(12).select(F.row_number().over(Window.orderBy(*order)).alias("call"), "anchor", "cat")


@query("op_src_22_identity_conflicts", """WITH g AS (SELECT l_orderkey AS record, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS low FROM lineitem GROUP BY 1)
SELECT record, CASE WHEN n = 1 THEN 'REUSE' ELSE 'IDENTITY_CONFLICT' END AS outcome, CASE WHEN n = 1 THEN low END AS entity_id FROM g""")
def identity_conflicts(spark, sf):
    g = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record")).agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("low"))
    return g.select("record", F.when(F.col("n") == 1, "REUSE").otherwise("IDENTITY_CONFLICT").alias("outcome"), F.when(F.col("n") == 1, F.col("low")).alias("entity_id"))


@query("op_flt_01_valid_ranges", "SELECT s_suppkey FROM supplier WHERE s_acctbal IS NOT NULL AND NOT isnan(s_acctbal) AND s_acctbal BETWEEN 0 AND 5000")
def valid_ranges(spark, sf):
    return c.read(spark, sf, "supplier").where(F.col("s_acctbal").between(0, 5000) & ~F.isnan("s_acctbal")).select("s_suppkey")


@query("op_flt_03_text_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_partkey LIMIT 10")
def text_contains(spark, sf):
    return c.read(spark, sf, "part").where(F.contains(F.lower("p_name"), F.lit("an"))).select("p_partkey", "p_name").orderBy("p_partkey").limit(10)


@query("op_flt_05_page_with_total", """SELECT o_orderkey, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40), (SELECT count(*) AS total FROM orders WHERE o_orderpriority = '1-URGENT')""")
def page_with_total(spark, sf):
    own = c.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate")
    total = own.agg(F.count("*").alias("total"))
    page = own.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)
    return page.join(F.broadcast(total)).select("o_orderkey", "total", F.ceil(F.col("total") / 20).alias("pages"))  # one row


@query("op_flt_06_exists_child", with_("experience component", "SELECT experience_id FROM experience e WHERE EXISTS (SELECT 1 FROM component m WHERE m.experience_id = e.experience_id AND m.state = 'UNRESOLVED')"))
def exists_child(spark, sf):
    return c.experience(spark, sf).join(c.component(spark, sf).where("state = 'UNRESOLVED'"), "experience_id", "left_semi").select("experience_id")


@query("op_flt_07_composites", with_("component", "SELECT experience_id, count(DISTINCT entity_id) AS members FROM component WHERE state = 'RESOLVED' GROUP BY 1 HAVING count(DISTINCT entity_id) >= 2"))
def composites(spark, sf):
    return c.component(spark, sf).where("state = 'RESOLVED'").groupBy("experience_id").agg(F.count_distinct("entity_id").alias("members")).where("members >= 2")


@query("op_flt_08_json_path", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def json_path(spark, sf):
    return c.read(spark, sf, "events").where(F.get_json_object("props", "$.k").cast("long") == 7).select("event_id")


@query("op_flt_09_array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'ring')")
def array_contains(spark, sf):
    return c.read(spark, sf, "part").where(F.array_contains(F.split(F.lower("p_name"), " "), "ring")).select("p_partkey")


@query("op_flt_11_hard_exclusions", with_("facet", ", x AS (SELECT DISTINCT experience_id FROM facet WHERE facet IN ('bolt', 'gear', 'widget')) SELECT p_partkey AS experience_id FROM part WHERE p_partkey NOT IN (SELECT experience_id FROM x)"))
def hard_exclusions(spark, sf):
    aliases = spark.createDataFrame([("part", "bolt"), ("part", "gear"), ("part", "widget")], "term string, facet string")
    hit = c.facet(spark, sf).join(F.broadcast(aliases), "facet", "left_semi")  # a constant table
    return c.read(spark, sf, "part").select(F.col("p_partkey").alias("experience_id")).join(hit, "experience_id", "left_anti")


@query("op_flt_13_strong_match", with_("experience component facet", """SELECT e.experience_id FROM experience e JOIN facet f USING (experience_id) WHERE f.facet = 'ring' AND e.quality BETWEEN 3 AND 5 AND e.duration_minutes <= 150
  AND EXISTS (SELECT 1 FROM component m WHERE m.experience_id = e.experience_id AND m.state = 'RESOLVED')"""))
def strong_match(spark, sf):
    q = valid_quality(F.col("quality"))
    e = c.experience(spark, sf).where((q >= FLOOR) & (F.col("duration_minutes") <= 150)).select("experience_id")
    return e.join(c.facet(spark, sf).where("facet = 'ring'"), "experience_id", "left_semi").join(c.component(spark, sf).where("state = 'RESOLVED'"), "experience_id", "left_semi")


@query("op_flt_14_facet_match", with_("facet request", "SELECT request_id, count(DISTINCT experience_id) AS matches FROM request LEFT JOIN facet ON facet = theme AND dimension = 'theme' GROUP BY 1"))
def facet_match(spark, sf):
    f = c.facet(spark, sf).where("dimension = 'theme'")
    return c.request(spark).join(f, F.col("theme") == F.col("facet"), "left").groupBy("request_id").agg(F.count_distinct("experience_id").alias("matches"))


@query("op_flt_16_structural_kind", "SELECT p_partkey, CASE WHEN p_type LIKE '%PROMO%' OR p_name LIKE '%ring%' THEN 'ROUTE' WHEN p_size >= 40 THEN 'AREA' WHEN p_brand IS NOT NULL THEN 'PLACE' ELSE 'UNKNOWN' END AS kind FROM part")
def structural_kind(spark, sf):
    kind = F.when(F.col("p_type").like("%PROMO%") | F.col("p_name").like("%ring%"), "ROUTE").when(F.col("p_size") >= 40, "AREA").when(F.col("p_brand").isNotNull(), "PLACE").otherwise("UNKNOWN")
    return c.read(spark, sf, "part").select("p_partkey", kind.alias("kind"))


@query("op_join_02_inner_ids", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45")
def inner_ids(spark, sf):
    l = c.read(spark, sf, "lineitem").where("l_quantity > 45")  # noqa: E741
    p, s = c.read(spark, sf, "part").select("p_partkey", "p_name"), c.read(spark, sf, "supplier").select("s_suppkey", "s_name")
    return l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("op_join_05_two_paths", """WITH k AS (SELECT s_suppkey AS id, lower(s_name) AS name FROM supplier), a AS (SELECT DISTINCT o_custkey AS id, lower(p_name) AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49),
asked AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size = 50 UNION SELECT lower(s_name) FROM supplier WHERE s_acctbal > 5000)
SELECT id, min(path) AS path FROM (SELECT id, 'canonical' AS path FROM k JOIN asked USING (name) UNION ALL SELECT id, 'hint' FROM a JOIN asked USING (name)) GROUP BY 1""")
def two_paths(spark, sf):
    """Entities found by their canonical name or by a remembered hint; the canonical path wins."""
    part, supplier = c.read(spark, sf, "part"), c.read(spark, sf, "supplier")
    k = supplier.select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("name"))
    lines = c.read(spark, sf, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_partkey")
    hints = lines.join(c.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("id"), F.lower("p_name").alias("name"))
    asked = part.where("p_size = 50").select(F.lower("p_name").alias("name")).union(supplier.where("s_acctbal > 5000").select(F.lower("s_name"))).distinct()
    found = k.withColumn("path", F.lit("canonical")).unionByName(hints.withColumn("path", F.lit("hint"))).join(asked, "name", "left_semi")
    return found.groupBy("id").agg(F.min("path").alias("path"))


@query("op_join_08_owners_of_any_id", "SELECT DISTINCT l_suppkey AS entity_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_totalprice > 400000)")
def owners_of_any_id(spark, sf):
    """Entities that own any of the asked ids; these are a table joined to all rows."""
    asked = c.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O' and o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return c.read(spark, sf, "lineitem").join(asked, "l_orderkey", "left_semi").select(F.col("l_suppkey").alias("entity_id")).distinct()


@query("op_join_09_missing_evidence", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def missing_evidence(spark, sf):
    o = c.read(spark, sf, "orders")
    return o.where("o_orderpriority = '5-LOW'").select("o_custkey").distinct().join(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), "o_custkey", "left_anti")


@query("op_join_10_candidate_pool", """WITH p AS (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON lower(x.p_name) = lower(y.p_name) AND x.p_partkey <> y.p_partkey
  UNION SELECT x.l_partkey, y.l_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) y ON x.l_suppkey = y.l_suppkey AND x.l_partkey <> y.l_partkey)
SELECT a, b, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY b) AS INTEGER) AS rank FROM p) WHERE rank <= 50""")
def candidate_pool(spark, sf):
    """The first 50 others, by id, that share the name or a member with each part.

    Of a name's or member's parts only the 51 of smallest id can be among anybody's first 50, so a key keeps those in one
    row. The first four of each key of a part, or all 51 of one key, are others enough to bound its 50th; only pairs up to
    that bound are built, a few more than the result holds.
    """
    names = c.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("n"), F.lower("p_name")).alias("k"))
    members = c.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("k"))
    every = names.unionByName(members).where("k is not null and id is not null").distinct()
    ranked = every.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where("n <= 51")
    first = ranked.groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("first"))
    heads = first.select("k", F.slice("first", 1, 4).alias("head"), F.get("first", F.lit(50)).alias("full"))
    seen = every.withColumnRenamed("id", "a").join(heads, "k").groupBy("a").agg(F.collect_list("k").alias("keys"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("head")))).alias("seen"), F.min("full").alias("full"))
    # Of 51 different ids, 50 at least are others. Null: there is no bound, and all are taken.
    bound = F.least(F.get("seen", F.lit(50)), F.col("full"))
    asked = seen.select("a", bound.alias("bound"), F.explode("keys").alias("k"))
    near = F.filter("first", lambda b: (b != F.col("a")) & (F.col("bound").isNull() | (b <= F.col("bound"))))
    pairs = asked.join(first, "k").select("a", F.explode(near).alias("b")).distinct()
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where("rank <= 50")


@query("op_agg_02_count_where", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05")
def count_where(spark, sf):
    return c.read(spark, sf, "lineitem").where("l_returnflag = 'R' and l_discount > 0.05").agg(F.count("*").alias("n"))


@query("op_agg_03_status_histogram", with_("outbox", """, d(status) AS (VALUES ('PENDING'), ('PROCESSING'), ('PROCESSED'), ('FAILED'), ('DEAD'))
SELECT d.status, count(event_id) AS n, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(created_at))) / 1e6) AS BIGINT) AS oldest_s FROM d LEFT JOIN outbox o ON o.status = d.status GROUP BY 1"""))
def status_histogram(spark, sf):
    d = spark.createDataFrame([(x,) for x in ("PENDING", "PROCESSING", "PROCESSED", "FAILED", "DEAD")], "status string")
    n = c.outbox(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.min("created_at").alias("low"))
    age = F.floor((F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp"))) / 1000000)
    return d.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), age.cast("long").alias("oldest_s"))


@query("op_agg_04_day_totals", """SELECT l_orderkey AS tour, l_linenumber AS day, count(*) AS stops, CAST(floor(sum(l_quantity) * 60 + 0.5) AS BIGINT) AS seconds, CAST(floor(sum(l_extendedprice) + 0.5) AS BIGINT) AS metres FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY 1, 2""")
def day_totals(spark, sf):
    g = c.read(spark, sf, "lineitem").where("l_linenumber is not null").groupBy(F.col("l_orderkey").alias("tour"), F.col("l_linenumber").alias("day"))
    # Exact sums: those of doubles hang on the order of the rows, and a half then falls to either side.
    total = lambda x: F.sum(F.col(x).cast("decimal(24,6)"))
    half_up = lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    return g.agg(F.count("*").alias("stops"), half_up(total("l_quantity") * 60).alias("seconds"), half_up(total("l_extendedprice")).alias("metres"))


@query("op_agg_05_residual_capacity", "SELECT l_orderkey AS tour, 660 - sum(l_quantity) AS residual, 660 - sum(l_quantity) >= 60 AS meaningful FROM lineitem GROUP BY 1")
def residual_capacity(spark, sf):
    r = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tour")).agg((660 - F.sum("l_quantity")).alias("residual"))
    return r.withColumn("meaningful", F.col("residual") >= 60)


@query("op_agg_06_completeness", """WITH t AS (SELECT l_orderkey AS tour, sum(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS substantial, sum(l_quantity) / 60 AS hours FROM lineitem GROUP BY 1)
SELECT tour, CAST(substantial AS BIGINT) AS substantial, hours >= 3 OR substantial >= 4 AS complete FROM t""")
def completeness(spark, sf):
    t = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tour")).agg(F.count_if(F.col("l_quantity") >= 45).alias("substantial"), (F.sum("l_quantity") / 60).alias("hours"))
    return t.select("tour", "substantial", F.expr("hours >= 3 or substantial >= 4").alias("complete"))


@query("op_agg_07_feasibility_audit", """WITH x AS (SELECT *, lag(l_shipdate) OVER w AS before, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate))
SELECT l_orderkey AS tour, 'CHRONOLOGY' AS issue, count(*) AS n FROM x WHERE l_shipdate < before GROUP BY 1 UNION ALL SELECT l_orderkey, 'DUPLICATE', count(*) FROM x WHERE n > 1 GROUP BY 1""")
def feasibility_audit(spark, sf):
    l = c.read(spark, sf, "lineitem")  # noqa: E741
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate")
    x = l.withColumn("before", F.lag("l_shipdate").over(order)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey", "l_partkey")))
    issues = F.array_compact(F.array(F.when(F.col("l_shipdate") < F.col("before"), "CHRONOLOGY"), F.when(F.col("n") > 1, "DUPLICATE")))
    return x.select(F.col("l_orderkey").alias("tour"), F.explode(issues).alias("issue")).groupBy("tour", "issue").agg(F.count("*").alias("n"))


@query("op_agg_10_portfolio_target", with_("request", "SELECT request_id, CAST(greatest(least(greatest(days, 1), 14) * CASE pace WHEN 'relaxed' THEN 3 WHEN 'moderate' THEN 4 ELSE 5 END, 4) AS INTEGER) AS target FROM request"))
def portfolio_target(spark, sf):
    pace = F.when(F.col("pace") == "relaxed", 3).when(F.col("pace") == "moderate", 4).otherwise(5)
    return c.request(spark).select("request_id", F.greatest(F.least(F.greatest("days", F.lit(1)), F.lit(14)) * pace, F.lit(4)).alias("target"))


@query("op_agg_14_reason_histogram", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def reason_histogram(spark, sf):
    return c.read(spark, sf, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 7).alias("reason")).agg(F.count("*").alias("n"))


@query("op_agg_15_set_union_merge", """SELECT p_brand, arg_max(p_name, (length(p_name), -p_partkey)) AS longest, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS size, bool_and(p_retailprice > 0) AS priced, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY 1""")
def set_union_merge(spark, sf):
    g = c.read(spark, sf, "part").groupBy("p_brand")
    return g.agg(F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("longest"), F.when(F.count_distinct("p_size") == 1, F.min("p_size")).alias("size"), F.bool_and(F.col("p_retailprice") > 0).alias("priced"), F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("types"))


@query("op_agg_18_heaviest_facet", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def heaviest_facet(spark, sf):
    best = c.read(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("x"))
    return best.select("o_custkey", (-F.col("x.k")).alias("o_orderkey"), F.col("x.o_totalprice").alias("o_totalprice"))


@query("op_win_01_strength_order", with_("experience facet", "SELECT facet, experience_id, rank FROM (SELECT facet, experience_id, CAST(row_number() OVER (PARTITION BY facet ORDER BY round(quality, 6) DESC NULLS LAST, experience_id) AS INTEGER) AS rank FROM facet JOIN experience USING (experience_id) WHERE dimension = 'theme')"))
def strength_order(spark, sf):
    f = c.facet(spark, sf).where("dimension = 'theme'").join(c.experience(spark, sf).select("experience_id", "quality"), "experience_id")
    order = Window.partitionBy("facet").orderBy(F.desc_nulls_last(F.round("quality", 6)), "experience_id")
    return f.withColumn("rank", F.row_number().over(order)).select("facet", "experience_id", "rank")


@query("op_win_02_strong_weak_split", with_("experience facet", "SELECT facet, count(*) FILTER (quality >= 3) AS strong, count(*) FILTER (quality < 3 OR quality IS NULL) AS weak FROM facet JOIN experience USING (experience_id) WHERE dimension = 'theme' GROUP BY 1"))
def strong_weak_split(spark, sf):
    f = c.facet(spark, sf).where("dimension = 'theme'").join(c.experience(spark, sf).select("experience_id", "quality"), "experience_id")
    return f.groupBy("facet").agg(F.count_if(F.col("quality") >= 3).alias("strong"), F.count_if(~F.coalesce(F.col("quality") >= 3, F.lit(False))).alias("weak"))


@query("op_win_07_travel_from_previous", "SELECT l_orderkey, l_linenumber, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step FROM lineitem")
def travel_from_previous(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return c.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - F.lag("l_extendedprice").over(order)).alias("step"))


@query("op_win_08_islands", """WITH x AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT user_id, event_type, CAST(island AS BIGINT) AS island, count(*) AS run FROM y GROUP BY ALL HAVING count(*) >= 3""")
def islands(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = c.read(spark, sf, "events").withColumn("c", F.when(F.lag("event_type").over(order).eqNullSafe(F.col("event_type")), 0).otherwise(1))
    y = x.withColumn("island", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return y.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("run")).where("run >= 3")


@query("op_win_09_first_occurrence", "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2")
def first_occurrence(spark, sf):
    return c.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("position"))


@query("op_top_02_fifo_claim", with_("outbox", "SELECT event_id FROM outbox WHERE status = 'PENDING' ORDER BY created_at, event_id LIMIT 50"))
def fifo_claim(spark, sf):
    return c.outbox(spark, sf).where("status = 'PENDING'").orderBy("created_at", "event_id").limit(50).select("event_id")


@query("op_top_07_retention", with_("outbox", "SELECT count(*) AS kept FROM outbox WHERE NOT (status = 'PROCESSED' AND created_at < TIMESTAMP '2024-01-20') AND NOT (status = 'FAILED' AND created_at < TIMESTAMP '2024-01-10')"))
def retention(spark, sf):
    old = lambda s, d: (F.col("status") == s) & (F.col("created_at") < F.lit(d).cast("timestamp"))
    return c.outbox(spark, sf).where(~old("PROCESSED", "2024-01-20") & ~old("FAILED", "2024-01-10")).agg(F.count("*").alias("kept"))


@query("op_set_01_union_last_wins", """SELECT id, side FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC) AS n FROM (SELECT o_custkey AS id, 1 AS side FROM orders UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 4 = 0)) WHERE n = 1""")
def union_last_wins(spark, sf):
    a = c.read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit(1).alias("side"))
    b = c.read(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.lit(2).alias("side"))
    return a.unionByName(b).groupBy("id").agg(F.max("side").alias("side"))


_SETS = """WITH s AS (SELECT o_custkey AS owner, l_orderkey AS k, list_distinct(list(l_suppkey)) AS a FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), e AS (SELECT owner, k, a FROM s UNION ALL SELECT o_custkey, o_orderkey, [] FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
p AS (SELECT x.k AS left_id, y.k AS right_id, x.a, y.a AS b, len(list_intersect(x.a, y.a)) AS i FROM e x JOIN e y USING (owner) WHERE x.k < y.k)"""


def _sets(spark, sf):
    """Member sets of an owner's tours, each pair once; tours without members have the empty set."""
    s = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("left_id")).agg(F.collect_set("l_suppkey").alias("a"))
    e = c.read(spark, sf, "orders").select(F.col("o_orderkey").alias("left_id"), F.col("o_custkey").alias("owner")).join(s, "left_id", "left").withColumn("a", F.coalesce("a", F.array().cast("array<bigint>")))
    return e.join(e.withColumnsRenamed({"left_id": "right_id", "a": "b"}), "owner").where("left_id < right_id").withColumn("i", F.size(F.array_intersect("a", "b")))


@query("op_set_03_overlap", _SETS + " SELECT left_id, right_id, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 1e0 ELSE i / greatest(len(a), len(b)) END, 6) AS overlap FROM p")
def set_overlap(spark, sf):
    most = F.greatest(F.size("a"), F.size("b"))
    return _sets(spark, sf).select("left_id", "right_id", F.round(F.when(most == 0, 1.0).otherwise(F.col("i") / most), 6).alias("overlap"))


@query("op_set_04_jaccard", _SETS + " SELECT left_id, right_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1e0 ELSE i / (len(a) + len(b) - i) END, 6) AS jaccard FROM p")
def set_jaccard(spark, sf):
    any_ = F.size("a") + F.size("b") - F.col("i")
    return _sets(spark, sf).select("left_id", "right_id", F.round(F.when(any_ == 0, 1.0).otherwise(F.col("i") / any_), 6).alias("jaccard"))


@query("op_set_05_concept_overlap", _SETS + " SELECT left_id, right_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0e0 ELSE i / (len(a) + len(b) - i) END, 6) AS overlap FROM p")
def concept_overlap(spark, sf):
    any_ = F.size("a") + F.size("b") - F.col("i")
    return _sets(spark, sf).select("left_id", "right_id", F.round(F.when(any_ == 0, 0.0).otherwise(F.col("i") / any_), 6).alias("overlap"))


@query("op_set_07_shared_by_all", "SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS m FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE n = m")
def shared_by_all(spark, sf):
    l = c.read(spark, sf, "lineitem")  # noqa: E741
    all_ = l.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("m"))
    own = l.groupBy("l_orderkey", "l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))
    return own.join(all_, "l_orderkey").where("n = m").select("l_orderkey", "l_suppkey")
