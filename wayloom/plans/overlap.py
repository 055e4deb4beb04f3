"""Overlapping candidates of one pool, and members of two compositions that are the same source-defined member."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..operators.elimination import eliminated
from ..operators.spatial import copies, near_pairs
from ..sources import catalog as c
from ..sources.shared import Tables
from .more import order_conflict
from .registry import SQL, query

#: Names of places (constants), some of which hold others.
NAMES = ("Plaza", "Plaza Dorrego", "Museo", "Museo del Sur", "Café Sur", "cafe  sur", "Puente", "Puente Viejo", "Mercado", "Teatro", "Parque")


def candidates(spark, sf):
    """Orders as candidates of their customer's pool: must, coverage (unknown for a third), members, score."""
    k = F.col("l_orderkey")
    lines = c.read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = c.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pool"))
    rows = sizes.join(orders, "l_orderkey").select(k.alias("id"), "pool", (k % 10 == 0).alias("must"), F.when(k % 3 != 0, k * 7 % 5 / F.lit(4.0)).alias("coverage"), "n", (k * 37 % 101).cast("double").alias("score"))
    return rows, lines.join(orders, "l_orderkey").select(k.alias("id"), "pool", F.col("l_suppkey").alias("entity_id"))


def preference():
    """Best first: musts, known coverage, members, score, the id as text."""
    return [(~F.col("must")).alias("p1"), (-F.coalesce("coverage", F.lit(float("-inf")))).alias("p2"), (-F.col("n")).alias("p3"), (-F.col("score")).alias("p4"), F.col("id").cast("string").alias("p5")]


def overlapping(spark, sf):
    """Pairs (a, b) of one pool with members at most 150 m apart whose names match. Places meet first, few to a cell: entities
    of one position and folded name are one, so a member meets other places, not all of their copies."""
    k = F.col("entity_id")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    entities = c.geo_entity(spark, sf).where("entity_id < 1000003").select("entity_id", "latitude", "longitude", norm_name(name).alias("name")).where("name <> ''")
    places, on = copies(entities, "entity_id", ("name",))
    names = places.select("entity_id", "name")
    near = near_pairs(places, places, 150.0, "entity_id", "entity_id").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = near.join(names.select(F.col("entity_id").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("entity_id").alias("b"), F.col("name").alias("nb")), "b")
    same = same.where(F.contains("na", F.col("nb")) | F.contains("nb", F.col("na"))).select("a", "b")
    at = entities.join(places.withColumnRenamed("entity_id", "place"), list(on)).select("entity_id", "place")
    members = candidates(spark, sf)[1].join(at, "entity_id").select("pool", "id", "place").distinct()
    left = members.select("pool", F.col("id").alias("left"), F.col("place").alias("a")).join(same, "a")
    right = members.select("pool", F.col("id").alias("right"), F.col("place").alias("b"))
    return left.join(right, ["pool", "b"]).where("left < right").select(F.col("left").alias("a"), F.col("right").alias("b")).distinct()


@query("op_er_09_overlap_filter")
def overlap_filter(spark, sf):
    """Every candidate, whether it stays in its pool, and the better one that it repeats if not."""
    tables = Tables(spark, "overlap")
    rows = candidates(spark, sf)[0]
    lost = eliminated(rows, overlapping(spark, sf), preference(), tables)
    return rows.select("pool", "id").join(lost, "id", "left").select("pool", "id", F.col("by").isNull().alias("kept"), F.col("by").alias("overlaps_with"))


_MEMBERS = """m AS (SELECT l_orderkey AS k, l_linenumber AS position, CASE WHEN l_linenumber % 5 <> 0 THEN split_part(lower(p_name), ' ', 1) END AS wording, CASE WHEN (l_orderkey + l_suppkey) % 4 <> 0 THEN l_suppkey END AS entity FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("op_er_04_member_correspondence", f"""WITH conflicts AS ({SQL["op_er_06_order_conflict"]}), {_MEMBERS},
x AS (SELECT right_id AS incoming, left_id AS existing, 'i' AS side, m.* FROM conflicts JOIN m ON k = right_id UNION ALL SELECT right_id, left_id, 'e', m.* FROM conflicts JOIN m ON k = left_id),
w AS (SELECT incoming, existing, wording, count(DISTINCT entity) AS n, min(entity) AS only, count(DISTINCT side) AS sides FROM x WHERE wording IS NOT NULL GROUP BY ALL),
g AS (SELECT incoming, existing, entity, count(DISTINCT side) AS sides FROM x WHERE entity IS NOT NULL GROUP BY ALL),
y AS (SELECT x.*, coalesce('e:' || coalesce(x.entity, CASE WHEN w.n = 1 THEN w.only END), CASE WHEN w.n = 0 THEN 'w:' || x.wording END, 'at:' || side || ':' || position) AS class, coalesce(w.n <= 1 AND w.sides = 2, false) AS by_wording, coalesce(g.sides = 2, false) AS by_entity
 FROM x LEFT JOIN w USING (incoming, existing, wording) LEFT JOIN g USING (incoming, existing, entity))
SELECT incoming, existing, class, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (side = 'i') AS incoming_positions, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (side = 'e') AS existing_positions,
 concat_ws(',', CASE WHEN bool_or(by_wording) THEN 'SOURCE_WORDING' END, CASE WHEN bool_or(by_entity) THEN 'RESOLVED_GEOENTITY' END) AS basis, bool_or(entity IS NOT NULL) AS grounded
FROM y GROUP BY incoming, existing, class HAVING count(DISTINCT side) = 2""")
def member_correspondence(spark, sf):
    """Members that two compositions share: those of one entity or of one wording that names no two entities.

    So a class holds one entity at most, and is named by it, else by its wording; neither side nor order matter. Windows
    over a pair's members share one shuffle.
    """
    lines = c.read(spark, sf, "lineitem").join(c.read(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    wording = F.when(F.col("l_linenumber") % 5 != 0, F.substring_index(F.lower("p_name"), " ", 1))
    m = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("position"), wording.alias("wording"), F.when((F.col("l_orderkey") + F.col("l_suppkey")) % 4 != 0, F.col("l_suppkey")).alias("entity"))
    pairs = order_conflict(spark, sf).select(F.col("right_id").alias("incoming"), F.col("left_id").alias("existing"))
    side = lambda of, name: pairs.join(m, F.col(of) == F.col("k")).withColumn("side", F.lit(name)).drop("k")
    x = side("incoming", "i").unionByName(side("existing", "e"))
    pair = ("incoming", "existing")
    # A set over a window of the pair serves all groupings of it, so members travel once.
    every = F.collect_set(F.struct("wording", "entity", "side")).over(Window.partitionBy(*pair))
    x = x.withColumn("all", every)
    alike = F.filter("all", lambda o: o["wording"] == F.col("wording"))
    entities = F.array_distinct(F.array_compact(F.transform(alike, lambda o: o["entity"])))
    sides = lambda rows: F.size(F.array_distinct(F.transform(rows, lambda o: o["side"])))
    x = x.withColumns({"named": entities, "n_sides": sides(alike)})
    met = sides(F.filter("all", lambda o: o["entity"] == F.col("entity"))) == 2
    only = F.when(F.size("named") == 1, F.get("named", F.lit(0)))
    label = F.coalesce(F.concat(F.lit("e:"), F.coalesce("entity", only).cast("string")), F.when(F.size("named") == 0, F.concat(F.lit("w:"), "wording")), F.concat(F.lit("at:"), "side", F.lit(":"), F.col("position").cast("string")))
    x = x.select(*pair, "side", "position", "entity", label.alias("class"), (F.col("wording").isNotNull() & (F.size("named") <= 1) & (F.col("n_sides") == 2)).alias("by_wording"), (F.col("entity").isNotNull() & met).alias("by_entity"))
    places = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("position")))).cast("array<string>"), ",")
    basis = F.concat_ws(",", F.when(F.bool_or("by_wording"), "SOURCE_WORDING"), F.when(F.bool_or("by_entity"), "RESOLVED_GEOENTITY"))
    shared = x.groupBy(*pair, "class").agg(places("i").alias("incoming_positions"), places("e").alias("existing_positions"), basis.alias("basis"), F.bool_or(F.col("entity").isNotNull()).alias("grounded"))
    return shared.where("incoming_positions <> '' and existing_positions <> ''")
