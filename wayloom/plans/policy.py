"""Decision tables over members, pools, legs, spans and headings, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, haversine_sql
from ..functions.geometry import contains
from ..functions.policy import (
    CONTEXT_ATOMS, DEFICITS, DETOUR, OWN_NAMES, SENTENCE_ENDS, SPACE, WIDE_ENDS, acquisition_plan, authorization, composition_class, deficit_class, internal_walking, kind_compatibility, persistable, pool_outcome, qid, quotable,
    source_document, source_relation, span_support, speed_kmh, statements, travel_mode, visible_heading, walking_reasons,
)
from ..functions.text import norm_name
from ..operators.blocks import told_pairs
from ..sources import catalog as c
from ..sources.catalog import with_
from .geometry import _ODD, _SHAPE, shape, with_areas
from .knowledge import _PAIRS
from .registry import query
from .scalar import _NORM

_REASONS = list(DEFICITS)
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"


@query("op_er_33_deficit_class", with_("component", ", d(i, reason, operational, composition) AS (VALUES " + ", ".join(f"({i}, '{r}', {_TEXT(a)}, {_TEXT(b)})" for i, (r, (a, b)) in enumerate(DEFICITS.items())) + """)
SELECT experience_id, entity_id, reason, operational, composition, CASE WHEN composition = 'MISSING_KNOWLEDGE' AND reason <> 'RESOLUTION_REVOKED' THEN reason END AS persisted FROM component JOIN d ON i = (experience_id * 31 + entity_id * 7) % 10 WHERE state = 'UNRESOLVED'"""))
def deficit_classes(spark, sf):
    """Unresolved members: why, on the operational and the composition axis, and the reason that may be stored."""
    at = ((F.col("experience_id") * 31 + F.col("entity_id") * 7) % len(_REASONS) + 1).cast("int")
    m = c.component(spark, sf).where("state = 'UNRESOLVED'").select("experience_id", "entity_id", F.element_at(F.array(*map(F.lit, _REASONS)), at).alias("reason"))
    r = F.col("reason")
    return m.select("*", deficit_class(r).alias("operational"), composition_class(r).alias("composition"), persistable(r).alias("persisted"))


@query("op_er_30_acquisition_plan", with_("geo_entity", """SELECT entity_id, kind, CASE WHEN entity_id % 5 = 0 THEN '' WHEN kind <> 'PLACE' THEN 'NOMINATIM' WHEN entity_id % 3 = 0 THEN 'NOMINATIM,PLACES' ELSE 'NOMINATIM,PLACES,OVERTURE_IDENTITY' END AS strategies FROM geo_entity"""))
def acquisition_plans(spark, sf):
    k = F.col("entity_id")
    plan = acquisition_plan(F.col("kind"), k % 5 != 0, F.when(k % 3 != 0, F.lit("AR")))
    return c.geo_entity(spark, sf).select("entity_id", "kind", F.array_join(plan, ",").alias("strategies"))


@query("op_er_07_source_relation", with_("component", _PAIRS + """, doc AS (SELECT p AS id, list(DISTINCT d) AS docs FROM (SELECT l_partkey AS p, 'https://example.org/Guide/' || l_suppkey % 4 AS d FROM lineitem WHERE l_quantity > 44) GROUP BY 1)
SELECT left_id, right_id, CASE WHEN x.docs IS NULL OR y.docs IS NULL THEN 'SOURCE_UNKNOWN' WHEN list_has_any(x.docs, y.docs) THEN 'SAME_SOURCE' ELSE 'DIFFERENT_SOURCE' END AS relation FROM r LEFT JOIN doc x ON x.id = left_id LEFT JOIN doc y ON y.id = right_id"""))
def source_relations(spark, sf):
    """Do two experiences come from one document? URLs differ in the case of their host, in fragments and a last slash. The
    documents stand beside each experience before pairs meet, and those of equal documents are told of at once."""
    k = F.col("l_suppkey")
    url = F.concat(F.when(k % 2 == 0, "HTTPS://Example.org/Guide/").otherwise(" https://example.ORG/Guide/"), (k % 4).cast("string"), F.when(k % 3 == 0, "/").when(k % 3 == 1, "#part").otherwise("/#top"))
    lines = c.read(spark, sf, "lineitem").where("l_quantity > 44")
    docs = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(source_document(url)).alias("docs"))
    keys = ["p_brand", "p_size", "p_type"]
    held = c.resolved_member(spark, sf).select(F.col("experience_id").alias("id"))
    parts = c.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), *keys).join(held, "id", "left_semi").join(docs, "id", "left")
    parts = parts.withColumn("docs", F.sort_array(F.coalesce("docs", F.array().cast("array<string>"))))
    return told_pairs(parts, keys, ["docs"], lambda x, y: source_relation(x("docs"), y("docs"))).withColumnRenamed("told", "relation")


@query("op_er_15_contextual_pool", with_("geo_entity", _SHAPE + f""", pt AS (SELECT entity_id, entity_id // 4 AS pool, CASE WHEN basis <> 'NONE' THEN latitude END AS latitude, CASE WHEN basis <> 'NONE' THEN longitude END AS longitude, CASE WHEN entity_id % 7 = 0 THEN NULL WHEN entity_id % 7 < 5 THEN 'POINT_OF_INTEREST' ELSE 'SETTLEMENT' END AS structural FROM shape),
hit AS (SELECT p.entity_id, e.area_id, e.ring, {_ODD.format(x='p.longitude', y='p.latitude')} AS odd FROM pt p, area_edge e WHERE p.latitude IS NOT NULL GROUP BY ALL),
rel AS (SELECT entity_id, area_id, bool_or(odd AND ring = 0) AND NOT bool_or(odd AND ring > 0) AS inside FROM hit GROUP BY ALL),
m AS (SELECT pool, a.area_id, structural, inside, CASE pool % 3 WHEN 1 THEN 'POINT_OF_INTEREST' WHEN 2 THEN 'SETTLEMENT' END AS wanted FROM pt CROSS JOIN (SELECT DISTINCT area_id FROM area_edge) a LEFT JOIN rel USING (entity_id, area_id)),
n AS (SELECT pool, area_id, count(*) AS members, count(*) FILTER (inside AND fits) AS inside, count(*) FILTER (inside IS NULL AND fits) AS undetermined, count(*) FILTER (inside AND fits AND wanted IS NOT NULL AND structural IS NULL) AS unknown FROM (SELECT *, wanted IS NULL OR structural IS NULL OR structural = wanted AS fits FROM m) GROUP BY ALL)
SELECT pool, area_id, members, inside, undetermined, CASE WHEN pool % 11 = 0 THEN NULL WHEN inside > 1 THEN 'AMBIGUOUS' WHEN inside = 0 AND undetermined > 0 THEN 'INCOMPLETE_COMPARISON' WHEN inside = 0 THEN 'NO_CONSISTENT_MEMBER'
 WHEN undetermined > 0 OR pool % 4 = 0 THEN 'INCOMPLETE_COMPARISON' WHEN unknown > 0 THEN 'KIND_UNESTABLISHED' ELSE 'DISTINGUISHED' END AS outcome FROM n"""))
def contextual_pool(spark, sf):
    """Members of one name against the locality that the source states: which of them can be meant? No outcome where the
    locality isn't grounded. Counts per pool, so pools of any size combine before the shuffle."""
    k, pool = F.col("entity_id"), F.col("pool")
    s = with_areas(shape(spark, sf).withColumn("pool", F.floor(k / 4)))
    asserted = F.when(pool % 3 == 1, "ESTABLISHMENT").when(pool % 3 == 2, "LOCALITY")
    structural = F.when(k % 7 == 0, F.lit(None)).when(k % 7 < 5, "POINT_OF_INTEREST").otherwise("SETTLEMENT")
    m = s.select(pool, "area_id", kind_compatibility(asserted, structural).alias("kind"), F.when(F.col("basis") != "NONE", contains(F.col("rings"), F.col("longitude"), F.col("latitude"))).alias("in"))
    fits, inside = F.col("kind") != "INCOMPATIBLE", F.coalesce("in", F.lit(False))
    n = m.groupBy("pool", "area_id").agg(F.count("*").alias("members"), F.count_if(fits & inside).alias("inside"), F.count_if(fits & F.col("in").isNull()).alias("undetermined"), F.count_if(inside & (F.col("kind") == "UNKNOWN")).alias("unknown"))
    outcome = F.when(pool % 11 != 0, pool_outcome(F.col("inside"), F.col("undetermined"), pool % 4 != 0, F.col("unknown")))
    return n.select("pool", "area_id", "members", "inside", "undetermined", outcome.alias("outcome"))


@query("op_er_14_competitors", with_("geo_entity", """, m AS (SELECT entity_id // 8 AS hint, entity_id % 2 AS pool, entity_id % 8 = entity_id // 8 % 8 AS own, entity_id % 4 = 1 AS namespace FROM geo_entity
  WHERE entity_id % 5 <> 0 AND kind = CASE WHEN entity_id // 8 % 3 = 0 THEN 'AREA' ELSE 'PLACE' END AND entity_id % 7 <> 0 AND entity_id % 11 <> 0),
p AS (SELECT hint, pool, count(*) FILTER (NOT own) AS others, bool_or(own) AS holds, coalesce(bool_or(NOT own AND namespace), false) AS shares FROM m GROUP BY ALL),
h AS (SELECT hint, max(CASE WHEN holds OR shares THEN others ELSE greatest(0, others - 1) END) AS n, bool_or(holds AND others = 0 AND (hint + pool) % 3 <> 0) AS examined FROM p GROUP BY 1)
SELECT a.hint, coalesce(n, 0) AS competitors, CASE WHEN n > 0 THEN 'MATERIAL_COMPETITOR_KNOWN' WHEN examined THEN 'NO_MATERIAL_COMPETITOR' ELSE 'NO_COMPETITOR_OBSERVED' END AS outcome FROM (SELECT DISTINCT entity_id // 8 AS hint FROM geo_entity) a LEFT JOIN h USING (hint)"""))
def competitors(spark, sf):
    """Who else answers to a hint? Counted in each pool of records, then the pool with the most decides.

    A pool that neither holds the candidate nor any record of its namespaces may hold it under another key: one of its
    records isn't counted.
    """
    k, hint, pool = F.col("entity_id"), F.col("hint"), F.col("pool")
    g = c.geo_entity(spark, sf).select("*", F.floor(k / 8).alias("hint"), (k % 2).alias("pool"))
    material = (k % 5 != 0) & (F.col("kind") == F.when(hint % 3 == 0, "AREA").otherwise("PLACE")) & (k % 7 != 0) & (k % 11 != 0)
    own, other = material & (k % 8 == hint % 8), material & (k % 8 != hint % 8)
    p = g.groupBy("hint", "pool").agg(F.count_if(other).alias("others"), F.bool_or(own).alias("holds"), F.bool_or(other & (k % 4 == 1)).alias("shares"))
    n = F.when(F.col("holds") | F.col("shares"), F.col("others")).otherwise(F.greatest(F.lit(0), F.col("others") - 1))
    alone = F.col("holds") & (F.col("others") == 0) & ((hint + pool) % 3 != 0)
    h = p.groupBy("hint").agg(F.max(n).alias("competitors"), F.bool_or(alone).alias("examined"))
    outcome = F.when(F.col("competitors") > 0, "MATERIAL_COMPETITOR_KNOWN").when(F.col("examined"), "NO_MATERIAL_COMPETITOR").otherwise("NO_COMPETITOR_OBSERVED")
    return h.select("hint", "competitors", outcome.alias("outcome"))


_ALLOWED = {0: ["WALKING", "DRIVING"], 1: ["PUBLIC_TRANSPORT", "WALKING"], 2: ["CYCLING"], 3: ["DRIVING", "CYCLING"]}
_ROUTING = f""", leg AS (SELECT experience_id, {haversine_sql('la', 'lo', 'latitude', 'longitude')} * 13e-1 AS m FROM (SELECT experience_id, latitude, longitude, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo FROM component JOIN geo_entity USING (entity_id) WHERE state = 'RESOLVED' WINDOW w AS (PARTITION BY experience_id ORDER BY position)) WHERE la IS NOT NULL),
routed AS (SELECT experience_id, sum(m / 1000 / CASE experience_id % 4 WHEN 2 THEN 13e0 WHEN 3 THEN 25e0 ELSE 45e-1 END * 60) AS minutes, sum(CASE WHEN experience_id % 4 < 2 THEN m ELSE 0e0 END) AS walking, max(CASE WHEN experience_id % 4 < 2 THEN m ELSE 0e0 END) AS longest, count(*) AS fallbacks FROM leg GROUP BY 1)"""


def _modes(key):
    return F.element_at(F.array(*[F.array(*map(F.lit, v)) for v in _ALLOWED.values()]), (key % 4 + 1).cast("int"))


def _routed(spark, sf):
    """Travel between consecutive members of one experience. Window and totals share one partitioning."""
    m = c.component(spark, sf).where("state = 'RESOLVED'").join(c.geo_entity(spark, sf), "entity_id")
    order = Window.partitionBy("experience_id").orderBy("position")
    metres = haversine_m(F.lag("latitude").over(order), F.lag("longitude").over(order), F.col("latitude"), F.col("longitude")) * DETOUR
    leg = m.select("experience_id", metres.alias("m")).where("m is not null")
    mode = travel_mode(_modes(F.col("experience_id")))
    walked = F.when(mode == "WALKING", F.col("m")).otherwise(0.0)
    return leg.groupBy("experience_id").agg(F.sum(F.col("m") / 1000 / speed_kmh(mode) * 60).alias("minutes"), F.sum(walked).alias("walking"), F.max(walked).alias("longest"), F.count("*").alias("fallbacks"))


@query("op_plan_02_internal_routing", with_("geo_entity component", _ROUTING + " SELECT experience_id, round(minutes, 4) AS minutes, round(walking, 3) AS walking, round(longest, 3) AS longest, fallbacks FROM routed"))
def internal_routing(spark, sf):
    """Totals inside each experience of two and more places; all legs here are approximate, so each is a fallback."""
    return _routed(spark, sf).select("experience_id", F.round("minutes", 4).alias("minutes"), F.round("walking", 3).alias("walking"), F.round("longest", 3).alias("longest"), "fallbacks")


@query("op_plan_03_walking_feasibility", with_("geo_entity component", _ROUTING + """, x AS (SELECT p_partkey AS k, coalesce(walking, CASE WHEN p_partkey % 6 < 3 THEN 0e0 ELSE 15e2 END) AS own, coalesce(longest, CASE WHEN p_partkey % 6 < 3 THEN 0e0 ELSE 15e2 END) AS longest, CASE WHEN p_partkey % 5 = 0 THEN 0e0 ELSE p_partkey * 53 % 4000 END AS leg, p_partkey * 97 % 9000 AS before,
  [6e3, 15e3, 3e4][p_partkey % 3 + 1] AS per_day, [1e3, 25e2, 8e3][p_partkey % 3 + 1] AS at_once FROM part LEFT JOIN routed ON experience_id = p_partkey)
SELECT k AS experience_id, round(before + own + leg, 3) AS projected, concat_ws(',', CASE WHEN k % 4 < 2 AND before + own + leg > per_day THEN 'MAX_WALKING_PER_DAY_EXCEEDED' END, CASE WHEN leg > at_once OR longest > at_once THEN 'MAX_CONTINUOUS_WALKING_EXCEEDED' END) AS reasons FROM x"""))
def walking_feasibility(spark, sf):
    """May an experience follow on a day, by what is walked to it, inside it and before it?"""
    k = F.col("experience_id")
    x = c.read(spark, sf, "part").select(F.col("p_partkey").alias("experience_id")).join(_routed(spark, sf), "experience_id", "left")
    own = internal_walking(F.col("walking"), F.col("minutes"), k % 6 < 3)
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % 3 + 1).cast("int"))
    x = x.select(k, own.alias("own"), F.coalesce(F.col("longest"), own).alias("longest"), F.when(k % 5 == 0, 0.0).otherwise(k * 53 % 4000).alias("leg"), (k * 97 % 9000).alias("before"))
    projected = F.col("before") + F.col("own") + F.col("leg")
    reasons = walking_reasons(projected, F.col("leg"), F.col("longest"), _modes(k), pick(6e3, 15e3, 3e4), pick(1e3, 25e2, 8e3))
    return x.select(k, F.round(projected, 3).alias("projected"), F.array_join(reasons, ",").alias("reasons"))


@query("op_geo_24_authorization", with_("component", """SELECT experience_id, CASE WHEN n < 2 OR experience_id % 4 > 1 THEN 'DEFAULT' WHEN experience_id % 4 = 0 THEN 'WALK' ELSE 'ROUTE_LIKE' END AS authorized, CASE WHEN n >= 2 AND experience_id % 4 < 2 THEN 'intent:' || CASE experience_id % 4 WHEN 0 THEN 'walk' ELSE 'route_like' END END AS owned_deficit FROM (SELECT experience_id, count(DISTINCT entity_id) AS n FROM component GROUP BY 1)"""))
def authorizations(spark, sf):
    """What a work unit's own open intent allows each of its candidates; other deficits grant nothing."""
    k = F.col("experience_id")
    dimension, key = F.when(k % 4 == 3, "theme").otherwise("intent"), F.when(k % 4 == 0, "walk").when(k % 4 == 2, "culture").otherwise("route_like")
    grant = F.when((dimension == "intent") & key.isin("walk", "route_like"), key)
    n = c.component(spark, sf).groupBy("experience_id").agg(F.count_distinct("entity_id").alias("n"))
    kind = authorization(grant, F.col("n"))
    return n.select("experience_id", kind.alias("authorized"), F.when(kind != "DEFAULT", F.concat(F.lit("intent:"), grant)).alias("owned_deficit"))


@query("op_er_29_line_union", with_("geo_entity", _SHAPE + """, l AS (SELECT entity_id, CASE WHEN kind = 'ROUTE' AND path IS NOT NULL THEN list_transform(path, lambda p: printf('%.7f,%.7f', p.x, p.y)).list_aggregate('string_agg', ';') END AS key FROM shape WHERE kind = 'ROUTE')
SELECT a.entity_id, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN len(list_distinct([a.key, b.key])) END AS n_lines, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN md5(CASE WHEN a.key = b.key THEN a.key ELSE a.key || '|' || b.key END) END AS lines FROM l a JOIN l b ON b.entity_id = a.entity_id + CASE WHEN a.entity_id % 20 = 9 THEN 10 ELSE 0 END"""))
def line_union(spark, sf):
    """Stored and incoming lines of a route, each once by its vertices to seven decimals, stored ones first; null where a
    side is no line. The incoming side is the next route, or the same one over again with drifted digits."""
    s = shape(spark, sf).where("kind = 'ROUTE'")
    drift = F.transform("path", lambda p: F.struct((p["x"] + F.lit(1e-11)).alias("x"), (p["y"] - F.lit(1e-11)).alias("y")))
    k = F.col("entity_id")
    other = F.when(k % 20 == 9, k + 10).otherwise(k)
    b = s.select(k.alias("other"), drift.alias("incoming"))
    both = s.select(k, "path", other.alias("other")).join(b, "other")
    key = lambda line: F.array_join(F.transform(line, lambda p: F.format_string("%.7f,%.7f", p["x"], p["y"])), ";")
    keys = F.when(F.col("path").isNotNull() & F.col("incoming").isNotNull(), F.array_distinct(F.array(key("path"), key("incoming"))))
    return both.select("entity_id", F.when(keys.isNotNull(), F.size(keys)).alias("n_lines"), F.md5(F.array_join(keys, "|")).alias("lines"))


@query("op_er_31_equivalence_record", with_("geo_entity", f"""SELECT entity_id, CASE WHEN entity_id % 4 = 1 THEN 'Q' || (entity_id + 1) END AS declared_qid, CASE WHEN entity_id % 3 = 0 THEN 'av ' || {_NORM.format("name")} || ' ' || entity_id % 90 END AS exact_address,
 concat_ws('|', name, CASE WHEN entity_id % 5 = 1 THEN 'E' || entity_id % 50 END, CASE WHEN entity_id % 2 = 0 THEN 'Alt ' || entity_id % 70 END) AS own_names FROM geo_entity"""))
def equivalence_record(spark, sf):
    """What a record's tags declare of itself: item, exact address, own names (lists split at semicolons), each name once."""
    k, name, none = F.col("entity_id"), F.col("name"), F.lit(None).cast("string")
    tags = {
        "wikidata": F.when(k % 4 == 1, F.concat(F.lit(" Q"), (k + 1).cast("string"))).when(k % 4 == 2, "Q0123").when(k % 4 == 3, F.concat(F.lit("Q12;Q"), k.cast("string"))),
        "addr:street": F.when(k % 3 < 2, F.concat(F.lit("Áv. "), name)), "addr:housenumber": F.when(k % 3 != 1, (k % 90).cast("string")),
        "name": F.when(k % 2 == 0, name), "short_name": F.when(k % 5 == 1, F.concat(F.lit("E"), (k % 50).cast("string"), F.lit("; "), name)),
        "alt_name": F.when(k % 2 == 0, F.concat(name, F.lit(" ;; Alt "), (k % 70).cast("string"))), "official_name": none,
    }
    g = c.geo_entity(spark, sf).withColumn("tags", F.map_filter(F.create_map(*[x for n, v in tags.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull()))
    tag = lambda n: F.try_element_at("tags", F.lit(n))
    street, number = (norm_name(F.coalesce(tag(f"addr:{n}"), F.lit(""))) for n in ("street", "housenumber"))
    own = F.flatten(F.array(*[F.coalesce(F.transform(F.split(tag(n), ";"), lambda v: F.trim(v)), F.array().cast("array<string>")) for n in OWN_NAMES]))
    own = F.when(tag("name").isNull(), F.concat(F.array("name"), own)).otherwise(own)
    address = F.when((street != "") & (number != ""), F.concat_ws(" ", street, number))
    return g.select("entity_id", qid(tag("wikidata")).alias("declared_qid"), address.alias("exact_address"), F.array_join(F.array_distinct(F.filter(own, lambda n: n != "")), "|").alias("own_names"))


_ATOM = """WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS atom, max(l_partkey) AS k, max(l_quantity) > 40 AS rejected FROM lineitem GROUP BY ALL),
x AS (SELECT *, coalesce(bool_or(rejected) OVER (PARTITION BY doc ORDER BY atom ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS soon FROM t)"""


@query("op_txt_18_relabel", _ATOM + " SELECT doc, atom, CASE WHEN rejected THEN 'SCOPE' WHEN soon THEN 'CONTEXT' END AS role, CASE WHEN NOT rejected AND k % 7 <> 0 THEN 'FIRST' || k % 3 WHEN k % 5 <> 0 AND rejected THEN 'SECOND' || k % 4 END AS label, CASE WHEN rejected AND k % 5 = 0 OR NOT rejected AND k % 7 = 0 THEN 'MISSING_ATOM' END AS issue FROM x")
def relabel(spark, sf):
    """Rejected atoms are labelled anew, with three atoms before each as context; what no labelling holds is missing."""
    t = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("atom")).agg(F.max("l_partkey").alias("k"), (F.max("l_quantity") > 40).alias("rejected"))
    soon = F.coalesce(F.bool_or("rejected").over(Window.partitionBy("doc").orderBy("atom").rowsBetween(1, CONTEXT_ATOMS)), F.lit(False))
    k, rejected = F.col("k"), F.col("rejected")
    first = F.when(k % 7 != 0, F.concat(F.lit("FIRST"), (k % 3).cast("string")))
    second = F.when(k % 5 != 0, F.concat(F.lit("SECOND"), (k % 4).cast("string")))
    label = F.when(rejected, second).otherwise(first)
    return t.select("doc", "atom", F.when(rejected, "SCOPE").when(soon, "CONTEXT").alias("role"), label.alias("label"), F.when(label.isNull(), "MISSING_ATOM").alias("issue"))


@query("op_txt_09_span_support", """WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS key, max(l_partkey) AS k FROM lineitem GROUP BY ALL), r AS (SELECT doc, key, k, p_name, CASE WHEN k % 13 = 0 THEN '' ELSE lower(p_brand) END AS title, CASE WHEN k % 13 = 0 THEN '' ELSE lower(p_name) END AS body FROM e JOIN part ON p_partkey = k),
s AS (SELECT doc, key, CASE k % 11 WHEN 3 THEN '' WHEN 5 THEN 'not in any' ELSE lower(p_name) END AS span FROM r),
m AS (SELECT s.doc, s.key, s.span, min(r.key) FILTER (hit AND r.key BETWEEN s.key + 1 AND s.key + 2) AS cited, coalesce(bool_or(r.title <> '') FILTER (r.key BETWEEN s.key + 1 AND s.key + 2), false) AS seen, count(*) FILTER (hit) AS n, min(r.key) FILTER (hit) AS sole
 FROM s JOIN (SELECT * FROM r) r USING (doc), LATERAL (SELECT s.span <> '' AND (contains(r.title, s.span) OR contains(r.body, s.span)) AS hit) GROUP BY ALL)
SELECT doc, key, CASE WHEN span = '' THEN 'NO_SUPPORT_SPAN' WHEN cited IS NOT NULL THEN 'DECLARED_KEY_VERIFIED' WHEN n = 1 THEN 'REATTRIBUTED_UNIQUE_EXACT_SPAN' WHEN n > 1 THEN 'AMBIGUOUS_SUPPORTING_EVIDENCE' WHEN seen THEN 'SPAN_NOT_FOUND_IN_CITED_EVIDENCE' ELSE 'MISSING_EVIDENCE_TEXT' END AS status, CASE WHEN span = '' THEN NULL WHEN cited IS NOT NULL THEN cited WHEN n = 1 THEN sole END AS verified_key FROM m""")
def span_supports(spark, sf):
    """Is a component's quoted span in the evidence it cites (the next two items), else in exactly one item of its document?

    Spans meet the items of their own document only; counts per span combine before the shuffle.
    """
    e = c.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("key")).agg(F.max("l_partkey").alias("k"))
    r = e.join(c.read(spark, sf, "part"), F.col("k") == F.col("p_partkey"))
    k, name = F.col("k"), F.col("p_name")
    body = F.when(k % 2 == 0, F.regexp_replace(name, r"(\w+) (\w+)", "**$1**\t$2")).otherwise(F.regexp_replace(name, r"^(\w+)", "[$1](https://example.org/a_b)"))
    r = r.select("doc", "key", k, name, F.when(k % 13 == 0, "").otherwise(quotable(F.col("p_brand"))).alias("title"), F.when(k % 13 == 0, "").otherwise(quotable(body)).alias("body"))
    span = F.when(k % 11 == 3, "  ").when(k % 11 == 5, "not in *any*").otherwise(F.upper(name))
    s = r.select("doc", F.col("key").alias("own"), quotable(span).alias("span"))
    hit = (F.col("span") != "") & (F.contains("title", "span") | F.contains("body", "span"))
    declared, key = F.col("key").between(F.col("own") + 1, F.col("own") + 2), F.col("key")
    n = s.join(r, "doc").groupBy("doc", "own", "span").agg(
        F.min(F.when(hit & declared, key)).alias("cited"), F.coalesce(F.bool_or(declared & (F.col("title") != "")), F.lit(False)).alias("seen"), F.count_if(hit).alias("n"), F.min(F.when(hit, key)).alias("sole"))
    status = span_support(F.col("span"), F.col("cited"), F.col("seen"), F.col("n"))
    verified = F.when(status == "DECLARED_KEY_VERIFIED", F.col("cited")).when(status == "REATTRIBUTED_UNIQUE_EXACT_SPAN", F.col("sole"))
    return n.select("doc", F.col("own").alias("key"), status.alias("status"), verified.alias("verified_key"))


@query("op_str_20_statements", f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '!\\[([^\\]]*)\\]\\([^)]*\\)', '\n\\1\n', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '[*_~`#]+', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '([{SENTENCE_ENDS}]){SPACE}+', '\\1\n', 'g'), '([{WIDE_ENDS}]){SPACE}*', '\\1\n', 'g'), '\n') AS p FROM a),
s AS (SELECT doc_id, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS s FROM b)
SELECT doc_id, CAST(generate_subscripts(s, 1) AS INTEGER) AS position, unnest(s) AS statement FROM s""")
def visible_statements(spark, sf):
    """Every statement of every whole text, in order."""
    d = c.read(spark, sf, "documents").select("doc_id", F.posexplode(statements(F.col("text"))).alias("position", "statement"))
    return d.select("doc_id", (F.col("position") + 1).alias("position"), "statement")


@query("op_str_21_visible_heading", "SELECT p_partkey, regexp_replace(p_name, '^(\\w+)', '\\1!') || ' in ' || p_type AS heading FROM part")
def visible_headings(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    marks = F.concat(F.repeat(F.lit(" "), (k % 4).cast("int")), F.repeat(F.lit("#"), (k % 6 + 1).cast("int")), F.lit("\t "))
    linked = F.regexp_replace(name, r"^(\w+)", "[**$1**!](https://example.org/x)")
    text = F.concat(marks, linked, F.lit("   _in_ ![`"), F.col("p_type"), F.lit("`](a.png)"), F.when(k % 2 == 0, " ## ").otherwise(""))
    return c.read(spark, sf, "part").select("p_partkey", visible_heading(text).alias("heading"))
