"""Sources that arrive in parts: places of a provider, boundaries in ways, labelled atoms of a text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import edges, ring_contains
from ..operators.rings import stitch
from ..sources import catalog as c
from ..sources.catalog import with_
from .geometry import _SHAPE, shape
from .registry import query

# Fixed values.
COMMERCIAL = (
    "point_of_interest establishment lodging hotel motel supermarket grocery_or_supermarket convenience_store store clothing_store department_store shopping_mall bank atm gas_station parking "
    "pharmacy drugstore hospital doctor dentist school university real_estate_agency car_repair car_dealer car_rental laundry post_office finance insurance_agency"
).split()
TOURISM = "tourist_attraction museum art_gallery park national_park historical_landmark historical_place church place_of_worship zoo aquarium amusement_park observation_deck visitor_center cultural_center campground winery".split()

_TYPES = [["museum", "point_of_interest"], ["store"], ["cafe"], ["point_of_interest", "establishment"], [], ["park"], ["bar", "store"], ["lodging", "zoo"]]
_ASKED = ["cafe", "store"]


def admissible(types, asked):
    """Some type was asked for (where none was: is one of tourism), and not all types are commercial."""
    known = F.filter(types, lambda t: F.trim(t) != "")
    wanted = F.when(F.size(asked) > 0, asked).otherwise(F.array(*map(F.lit, TOURISM)))
    return F.arrays_overlap(known, wanted) & ~F.forall(known, lambda t: t.isin(*COMMERCIAL))


@query("op_src_14_places", with_("geo_entity", """SELECT entity_id AS place_id, 'places:' || entity_id AS evidence_key, CASE WHEN entity_id % 6 = 1 THEN 'N ' || name ELSE name END AS title, CASE WHEN entity_id % 9 > 1 THEN latitude END AS latitude, CASE WHEN entity_id % 9 > 1 THEN longitude END AS longitude
FROM geo_entity WHERE entity_id % 6 <> 2 AND CASE WHEN entity_id % 5 = 0 THEN entity_id * 3 % 8 IN (2, 6) ELSE entity_id * 3 % 8 IN (0, 5, 7) END"""))
def places(spark, sf):
    """Records of a provider as observations: each id once, as its first page has it; admitted by type; with a title; a
    coordinate only where it is one."""
    k = F.col("id")
    g = c.geo_entity(spark, sf).select(F.col("entity_id").alias("id"), "name", "latitude", "longitude").withColumn("page", F.explode(F.array(F.lit(0), F.lit(1))))
    types = F.element_at(F.array(*[F.array(*map(F.lit, t)).cast("array<string>") for t in _TYPES]), ((k * 3 + F.col("page")) % 8 + 1).cast("int"))
    display = F.when(k % 6 == 0, F.concat(F.lit("  "), "name", F.lit(" "))).when(k % 6 < 3, "  ").otherwise(F.col("name"))
    plain = F.when(k % 6 == 1, F.concat(F.lit(" N "), "name"))
    latitude = F.when(k % 9 == 0, 95.0).when(k % 9 == 1, float("nan")).otherwise(F.col("latitude"))
    first = g.groupBy("id").agg(F.min_by(F.struct(types.alias("types"), display.alias("display"), plain.alias("plain"), latitude.alias("y"), F.col("longitude").alias("x")), "page").alias("r")).select("id", "r.*")
    asked = F.when(k % 5 == 0, F.array(*map(F.lit, _ASKED))).otherwise(F.array().cast("array<string>"))
    text = lambda n: F.when(F.trim(n) != "", F.trim(n))
    sound = F.col("y").between(-90, 90) & F.col("x").between(-180, 180) & ~F.isnan("y") & ~F.isnan("x")
    kept = first.where(admissible(F.col("types"), asked)).withColumn("title", F.coalesce(text("display"), text("plain"))).where("title is not null")
    return kept.select(k.alias("place_id"), F.concat(F.lit("places:"), k.cast("string")).alias("evidence_key"), "title", F.when(sound, F.col("y")).alias("latitude"), F.when(sound, F.col("x")).alias("longitude"))


@query("op_src_13_ring_stitching", with_("geo_entity", _SHAPE + """, s AS (SELECT entity_id, entity_id % 7 <> 0 AS whole, CASE WHEN entity_id % 3 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN entity_id % 2 = 0 THEN 1 ELSE 0 END AS h, (2e-3 * (entity_id % 4 + 1)) * (15e-4 * (entity_id % 5 + 1)) AS ab FROM shape WHERE kind = 'AREA' AND path IS NOT NULL)
SELECT entity_id, CASE WHEN NOT whole AND n = 1 THEN 'Point' WHEN whole AND n = 2 THEN 'MultiPolygon' ELSE 'Polygon' END AS type, CASE WHEN whole THEN n ELSE n - 1 END AS polygons, CASE WHEN NOT whole AND n = 1 THEN 0 ELSE h END AS holes, round(1e6 * CASE WHEN NOT whole AND n = 1 THEN 0 ELSE 4 * ab * CASE WHEN whole THEN n ELSE n - 1 END - ab * h END, 3) AS area FROM s"""))
def ring_stitching(spark, sf):
    """Boundaries that come as ways in any order and direction: a point where no outer ring closes, a polygon with all
    holes of one that does, several with the holes of each that holds their first point."""
    s = shape(spark, sf).where("kind = 'AREA' and path is not null")
    k, p = F.col("entity_id"), lambda line, i: F.element_at(line, i + 1)

    def ways(line, whole):
        a, b, d = F.array(p(line, 0), p(line, 1), p(line, 2)), F.array(p(line, 3), p(line, 2)), F.array(p(line, 3), p(line, 4))
        return F.when(~whole, F.array(a, d)).when(k % 4 == 0, F.array(a, b, d)).when(k % 4 == 1, F.array(d, a, b)).otherwise(F.array(b, d, a))

    moved = lambda line, by, scale: F.transform(line, lambda q: F.struct((F.col("longitude") + (q["x"] - F.col("longitude")) * scale + by).alias("x"), (F.col("latitude") + (q["y"] - F.col("latitude")) * scale).alias("y")))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    outer = F.concat(ways(F.col("path"), k % 7 != 0), F.when(k % 3 == 0, ways(moved("path", 1.0, 1.0), F.lit(True))).otherwise(none))
    inner = F.when(k % 2 == 0, ways(moved("path", 0.0, 0.5), F.lit(True))).otherwise(none)
    r = s.select("entity_id", stitch(outer).alias("outer"), stitch(inner).alias("inner"))
    first = lambda ring: F.element_at(ring, 1)
    holds = lambda o: F.filter("inner", lambda i: (F.size("outer") == 1) | ring_contains(edges(o), first(i)["x"], first(i)["y"]))
    # Corners relative to the first one, that no digits are lost.
    corner = lambda ring, e: (e["ax"] - first(ring)["x"]) * (e["by"] - first(ring)["y"]) - (e["bx"] - first(ring)["x"]) * (e["ay"] - first(ring)["y"])
    area = lambda ring: F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda t, e: t + corner(ring, e))) / 2
    total = lambda rings: F.aggregate(F.transform(rings, area), F.lit(0.0), lambda t, v: t + v)
    r = r.withColumn("held", F.flatten(F.transform("outer", holds)))
    n = F.size("outer")
    kind = F.when(n == 0, "Point").when(n == 1, "Polygon").otherwise("MultiPolygon")
    return r.select("entity_id", kind.alias("type"), n.alias("polygons"), F.size("held").alias("holes"), F.round((total(F.col("outer")) - total(F.col("held"))) * 1e6, 3).alias("area"))


_LABELLED = """WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS atom, max(l_partkey) AS k FROM lineitem GROUP BY ALL),
l AS (SELECT doc, atom, k % 3 = 0 AS transfer, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'PASS_BY' WHEN k % 5 = 2 THEN 'ALTERNATIVE' ELSE 'COMPONENT' END AS role, lower(p_name) AS name FROM t JOIN part ON p_partkey = k)"""


@query("op_txt_07_segments", _LABELLED + """, g AS (SELECT *, count(*) FILTER (transfer) OVER (PARTITION BY doc ORDER BY atom) AS leg FROM l),
o AS (SELECT doc, leg, min(atom) AS atom, bool_or(role IN ('ALTERNATIVE', 'COMPONENT')) AS own FROM g GROUP BY ALL),
s AS (SELECT doc, leg, 1 + count(*) FILTER (opens) OVER (PARTITION BY doc ORDER BY leg) AS segment FROM (SELECT *, coalesce(lag(own) OVER (PARTITION BY doc ORDER BY leg), false) AS opens FROM o)),
e AS (SELECT doc, atom, role = 'ALTERNATIVE' AND (transfer OR coalesce(lag(role) OVER (PARTITION BY doc ORDER BY atom), '') <> 'ALTERNATIVE') AS starts FROM l WHERE role IS NOT NULL OR transfer)
SELECT doc, segment, min(atom) AS first_atom, max(atom) AS last_atom, count(*) FILTER (transfer) AS transfers, count(DISTINCT name) FILTER (role IS NOT NULL) AS members, count(*) FILTER (starts) AS alternatives, coalesce(bool_or(role IN ('ALTERNATIVE', 'COMPONENT')), false) AS own FROM g JOIN s USING (doc, leg) LEFT JOIN e USING (doc, atom) GROUP BY ALL""")
def segments(spark, sf):
    """Labelled atoms to segments: a transfer opens one where the last has members of its own, else it joins the others
    that opened it. Whether it does only hangs on the atoms since the transfer before, so windows tell it; all of them
    share one sort by document and atom, dealt to as many tasks as the lines need."""
    k, n = F.col("k"), c.tasks(spark, sf, "lineitem")
    lines = c.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("atom"), F.col("l_partkey").alias("k"))
    t = lines.repartition(n, "doc").groupBy("doc", "atom").agg(F.max("k").alias("k"))
    role = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "PASS_BY").when(k % 5 == 2, "ALTERNATIVE").otherwise("COMPONENT")
    names = c.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("name"))
    a = t.repartition(n, "k").join(names, "k").repartition(n, "doc").select("doc", "atom", (k % 3 == 0).alias("transfer"), role.alias("role"), "name")
    so_far = Window.partitionBy("doc").orderBy("atom")
    leg = so_far.rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.col("role").isin("ALTERNATIVE", "COMPONENT"), F.lit(False))
    a = a.withColumn("leg", F.count_if("transfer").over(leg))
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    # The leg before a transfer had members of its own if the last such atom lies in it.
    opens = F.col("transfer") & F.coalesce(F.last(F.when(own, F.col("leg")), ignorenulls=True).over(earlier) == F.col("leg") - 1, F.lit(False))
    event = F.col("role").isNotNull() | F.col("transfer")
    before = F.last(F.when(event, F.coalesce(F.col("role") == "ALTERNATIVE", F.lit(False))), ignorenulls=True).over(earlier)
    starts = (F.col("role") == "ALTERNATIVE") & (F.col("transfer") | ~F.coalesce(before, F.lit(False)))
    a = a.withColumns({"opens": opens, "starts": starts}).withColumn("segment", F.count_if("opens").over(leg) + 1)
    return a.groupBy("doc", "segment").agg(
        F.min("atom").alias("first_atom"), F.max("atom").alias("last_atom"), F.count_if("transfer").alias("transfers"), F.count_distinct(F.when(F.col("role").isNotNull(), F.col("name"))).alias("members"), F.count_if("starts").alias("alternatives"), F.bool_or(own).alias("own"))
