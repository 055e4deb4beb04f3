"""Entity resolution, admission, hint knowledge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import token_jaccard, tokens
from ..operators.graph import clusters_by_name
from ..operators.resolution import admission, pair_verdict, structural_relation
from ..sources import catalog as c
from ..sources.catalog import with_
from ..sources.shared import Tables
from .registry import query

_PAIRS = """, m AS (SELECT experience_id AS id, list_sort(list(entity_id)) AS s FROM component WHERE state = 'RESOLVED' GROUP BY 1),
n AS (SELECT p_partkey AS id, p_brand, p_size, p_type, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part),
x AS (SELECT x.id AS left_id, y.id AS right_id, a.s AS a, b.s AS b, len(list_intersect(a.s, b.s)) AS i, CAST(len(list_intersect(x.t, y.t)) AS DOUBLE) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS jac FROM n x JOIN n y USING (p_brand, p_size, p_type) JOIN m a ON a.id = x.id JOIN m b ON b.id = y.id WHERE x.id < y.id),
r AS (SELECT *, CASE WHEN i = 0 THEN 'DISJOINT' WHEN i = len(a) AND i = len(b) THEN 'EXACT_COMPOSITION' WHEN i = len(a) OR i = len(b) THEN 'SUBCOMPOSITION' ELSE 'PARTIAL_OVERLAP' END AS relation FROM x)"""


def _pairs(spark, sf):
    """Pairs of experiences of one brand, size and type: members of both, their relation, the Jaccard of the names."""
    keys = ["p_brand", "p_size", "p_type"]
    m = c.component(spark, sf).where("state = 'RESOLVED'").groupBy(F.col("experience_id").alias("id")).agg(F.sort_array(F.collect_set("entity_id")).alias("a"))
    n = c.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), *keys, tokens(F.col("p_name")).alias("t")).join(m, "id").withColumnRenamed("id", "left_id")
    x = n.join(n.withColumnsRenamed({"left_id": "right_id", "a": "b", "t": "u"}), keys).where("left_id < right_id")
    return x.select("left_id", "right_id", "a", "b", structural_relation(F.col("a"), F.col("b")).alias("relation"), token_jaccard(F.col("t"), F.col("u")).alias("jac"))


@query("op_er_05_structural_relation", with_("component", _PAIRS + " SELECT left_id, right_id, relation FROM r"))
def relation(spark, sf):
    return _pairs(spark, sf).select("left_id", "right_id", "relation")


@query("op_er_02_pair_verdict", with_("component", _PAIRS + """
SELECT left_id, right_id, CASE relation WHEN 'EXACT_COMPOSITION' THEN CASE WHEN jac = 1 THEN 'SAME' ELSE 'AMBIGUOUS' END
 WHEN 'PARTIAL_OVERLAP' THEN CASE WHEN jac >= 0.72 OR i / greatest(len(a), len(b)) >= 0.5 THEN 'AMBIGUOUS' ELSE 'DISTINCT' END
 ELSE CASE WHEN jac >= 0.72 THEN 'AMBIGUOUS' ELSE 'DISTINCT' END END AS verdict FROM r"""))
def verdict(spark, sf):
    overlap = F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.size("b")) >= 0.5
    return _pairs(spark, sf).select("left_id", "right_id", pair_verdict(F.col("relation"), F.col("jac") >= 0.72, overlap, F.col("jac") == 1).alias("verdict"))


@query("op_er_18_admission", with_("component", """, g AS (SELECT experience_id, count(*) AS n, count(*) FILTER (state = 'RESOLVED') AS r, count(DISTINCT entity_id) FILTER (state = 'RESOLVED') AS d, count(*) FILTER (state = 'UNRESOLVED' AND entity_id % 5 = 0) AS b FROM component GROUP BY 1)
SELECT experience_id, CASE WHEN n = 0 THEN 'NO_MEMBERS' WHEN r = 0 THEN 'NO_RESOLVED_MEMBER' WHEN r = n THEN 'COMPLETE' WHEN d < 2 THEN 'BELOW_DISTINCT_FLOOR' WHEN b > 0 THEN 'BLOCKING_DEFICIT' ELSE 'PARTIAL' END AS admission FROM g"""))
def admissions(spark, sf):
    resolved = F.col("state") == "RESOLVED"
    g = c.component(spark, sf).groupBy("experience_id").agg(F.count("*").alias("n"), F.count_if(resolved).alias("r"), F.count_distinct(F.when(resolved, F.col("entity_id"))).alias("d"), F.count_if(~resolved & (F.col("entity_id") % 5 == 0)).alias("b"))
    return g.select("experience_id", admission(*map(F.col, "nrdb")).alias("admission"))


@query("op_er_12_equivalence_groups", "SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2 HAVING count(*) >= 2")
def equivalence_groups(spark, sf):
    return c.read(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n >= 2")


@query("op_er_13_components", """WITH RECURSIVE seg AS (SELECT DISTINCT o_custkey AS name, o_orderkey AS id, l_suppkey AS point FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
e AS (SELECT DISTINCT id AS a, min(id) OVER (PARTITION BY name, point) AS b FROM seg), b2 AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(node, low) AS (SELECT a, a FROM b2 UNION SELECT b2.b, r.low FROM r JOIN b2 ON b2.a = r.node WHERE r.low < b2.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY 1)
SELECT cluster, count(*) AS segments, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM (SELECT id, least(id, coalesce(low, id)) AS cluster FROM (SELECT DISTINCT id FROM seg) LEFT JOIN c ON node = id) GROUP BY 1""")
def route_components(spark, sf):
    """Segments (orders) of one name (customer) that share a point (supplier), transitively: clusters and their members."""
    tasks = c.tasks(spark, sf, "lineitem")
    o = c.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name")).repartition(tasks, "id").distinct()
    o = o.withColumn("shared", F.count("*").over(Window.partitionBy("id")) > 1)
    lines = c.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("point")).repartition(tasks, "l_orderkey")
    found = clusters_by_name(lines.join(o, F.col("l_orderkey") == F.col("id")), Tables(spark, "segments"), tasks)
    return found.select("cluster", F.size("ids").cast("long").alias("segments"), F.array_join("ids", ",").alias("members"))


@query("op_er_20_remember_hint", """WITH old AS (SELECT o_custkey AS entity, o_orderpriority AS hint, bool_or(o_orderstatus = 'F') AS revoked FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
new AS (SELECT DISTINCT o_custkey AS entity, o_orderpriority AS hint FROM orders WHERE o_orderkey % 2 = 1)
SELECT entity, hint, CASE WHEN old.revoked IS NULL THEN 'REMEMBERED' WHEN old.revoked THEN 'SUPPRESSED_BY_REVOCATION' ELSE 'ALREADY' END AS outcome FROM new LEFT JOIN old USING (entity, hint)""")
def remember_hint(spark, sf):
    o = c.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("hint"), "o_orderkey", "o_orderstatus")
    old = o.where("o_orderkey % 2 = 0").groupBy("entity", "hint").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("revoked"))
    new = o.where("o_orderkey % 2 = 1").select("entity", "hint").distinct()
    outcome = F.when(F.col("revoked").isNull(), "REMEMBERED").when(F.col("revoked"), "SUPPRESSED_BY_REVOCATION").otherwise("ALREADY")
    return new.join(old, ["entity", "hint"], "left").select("entity", "hint", outcome.alias("outcome"))


@query("op_er_21_revocation_cascade", with_("component", ", s AS (SELECT experience_id, count(*) FILTER (state = 'RESOLVED' AND entity_id % 17 <> 0) AS r, count(*) AS n FROM component GROUP BY 1) SELECT experience_id, CASE WHEN r = 0 THEN 'ARCHIVED' WHEN r = n THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM s"))
def revocation_cascade(spark, sf):
    kept = (F.col("state") == "RESOLVED") & (F.col("entity_id") % 17 != 0)
    s = c.component(spark, sf).groupBy("experience_id").agg(F.count_if(kept).alias("r"), F.count("*").alias("n"))
    return s.select("experience_id", F.when(F.col("r") == 0, "ARCHIVED").when(F.col("r") == F.col("n"), "COMPLETE").otherwise("PARTIAL").alias("status"))
