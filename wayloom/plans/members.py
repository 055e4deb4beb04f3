"""Compositions against each other: evidence of pairs, decisions, reconciliation of members, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, haversine_sql, in_polygon
from ..functions.policy import DEFICITS, decisive_evidence, deficit_class, evidence_total, reconciliation, relation_in_order, source_relation
from ..functions.text import overlap_ratio, token_jaccard, tokens
from ..operators.resolution import structural_relation
from ..sources import catalog as c
from ..sources.catalog import with_
from .more import order_conflict
from .registry import SQL, query
from .retrieval import AREA, _ring_sql

_RATIO = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / greatest(len({0}), len({1}))"
_EVIDENCE = f""", conflicts AS ({SQL["op_er_06_order_conflict"]}),
fp AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey) AS m, list(DISTINCT l_returnflag || '|' || l_suppkey) AS r, list(DISTINCT lower(p_type)) AS f, arg_min(string_split(lower(p_name), ' '), p_partkey) AS t, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS spot, any_value(o_orderpriority) AS p, CASE WHEN l_orderkey % 4 <> 0 THEN any_value(o_orderstatus) END AS doc
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
pt AS (SELECT fp.*, list_distinct(t) AS n, list_distinct(list_concat(t, f)) AS s, latitude, longitude FROM fp JOIN geo_entity ON entity_id = spot),
ev AS (SELECT right_id AS incoming, left_id AS existing, conflict, CAST(len(list_intersect(a.n, b.n)) AS DOUBLE) / len(list_distinct(list_concat(a.n, b.n))) AS name, {_RATIO.format('a.s', 'b.s')} AS semantic, {_RATIO.format('a.m', 'b.m')} AS members, {_RATIO.format('a.r', 'b.r')} AS roles, {_RATIO.format('a.f', 'b.f')} AS concept,
  CASE WHEN a.p = b.p THEN 1e0 ELSE 0e0 END AS provenance, CASE WHEN a.doc IS NULL OR b.doc IS NULL THEN 'SOURCE_UNKNOWN' WHEN a.doc = b.doc THEN 'SAME_SOURCE' ELSE 'DIFFERENT_SOURCE' END AS source, (len(a.m) = 1) <> (len(b.m) = 1) AS standalone, len(list_intersect(a.m, b.m)) AS i, len(a.m) AS la, len(b.m) AS lb,
  {haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} / 1000 AS km FROM conflicts JOIN pt a ON a.k = left_id JOIN pt b ON b.k = right_id),
rl AS (SELECT *, CASE WHEN i = la AND i = lb THEN 'EXACT_COMPOSITION' WHEN (i = la OR i = lb) AND NOT conflict THEN 'SUBCOMPOSITION' ELSE 'PARTIAL_OVERLAP' END AS relation, round(name * 22e-2 + semantic * 2e-1 + members * 15e-2 + roles * 3e-1 + provenance * 5e-2 + CASE WHEN km <= 0.5 THEN 8e-2 WHEN km <= 1.5 THEN 4e-2 ELSE 0e0 END, 6) AS score FROM ev),
judged AS (SELECT *, CASE WHEN relation = 'EXACT_COMPOSITION' THEN CASE WHEN roles = 1 AND (name = 1 OR concept = 1) AND NOT conflict THEN 'EXACT_COMPOSITION_IDENTITY_CONFIRMED' ELSE 'EXACT_COMPOSITION_IDENTITY_UNCONFIRMED' END
  WHEN name >= 72e-2 THEN 'STRUCTURAL_OVERLAP_WITH_SIMILAR_NAME' WHEN relation = 'PARTIAL_OVERLAP' AND NOT standalone AND (members >= 0.5 OR roles >= 4e-1) THEN 'PARTIAL_OVERLAP_IDENTITY_UNRESOLVED' WHEN standalone THEN 'STANDALONE_COMPOSITE_MEMBERSHIP' WHEN relation = 'PARTIAL_OVERLAP' THEN 'PARTIAL_OVERLAP_INSUFFICIENT'
  WHEN source = 'SAME_SOURCE' THEN 'SUBCOMPOSITION_SAME_SOURCE_CONTAINMENT' WHEN source = 'DIFFERENT_SOURCE' THEN 'SUBCOMPOSITION_DIFFERENT_SOURCE' ELSE 'SUBCOMPOSITION_SOURCE_UNKNOWN' END AS decisive FROM rl),
decided AS (SELECT *, CASE WHEN decisive = 'EXACT_COMPOSITION_IDENTITY_CONFIRMED' THEN 'SAME' WHEN decisive IN ('EXACT_COMPOSITION_IDENTITY_UNCONFIRMED', 'STRUCTURAL_OVERLAP_WITH_SIMILAR_NAME', 'PARTIAL_OVERLAP_IDENTITY_UNRESOLVED') THEN 'AMBIGUOUS' ELSE 'DISTINCT' END AS verdict FROM judged)"""


def _judged(spark, sf):
    """Tours of one owner that share a member, later ones against earlier ones: evidence, verdict, score.

    Fingerprints are one row per tour and travel once to each side of the pairs that really share something.
    """
    lines = c.read(spark, sf, "lineitem").join(c.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(c.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    fp = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set("l_suppkey").alias("m"), F.collect_set(F.concat_ws("|", "l_returnflag", F.col("l_suppkey").cast("string"))).alias("r"), F.collect_set(F.lower("p_type")).alias("f"), F.min_by("p_name", "p_partkey").alias("named"),
        F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("at"), F.first("o_orderpriority").alias("p"), F.first("o_orderstatus").alias("status"))
    docs = F.when(F.col("k") % 4 != 0, F.array("status")).otherwise(F.array().cast("array<string>"))
    places = c.geo_entity(spark, sf).select(F.col("entity_id").alias("at"), "latitude", "longitude")
    fp = fp.join(places, "at").withColumns({"n": tokens(F.col("named")), "docs": docs}).withColumn("s", F.array_union("n", "f"))
    side = lambda x: fp.select(F.col("k").alias(f"{x}_id"), F.struct("m", "r", "f", "n", "s", "p", "docs", "latitude", "longitude").alias(x))
    x = order_conflict(spark, sf).join(side("left"), "left_id").join(side("right"), "right_id")
    a, b = (lambda n: F.col(f"left.{n}")), (lambda n: F.col(f"right.{n}"))
    ratio = lambda n: overlap_ratio(a(n), b(n))
    e = {
        "name": token_jaccard(a("n"), b("n")), "semantic": ratio("s"), "members": ratio("m"), "roles": ratio("r"), "concept": ratio("f"), "provenance": F.when(a("p") == b("p"), 1.0).otherwise(0.0),
        "source": source_relation(a("docs"), b("docs")), "standalone": (F.size(a("m")) == 1) != (F.size(b("m")) == 1), "relation": relation_in_order(structural_relation(a("m"), b("m")), F.col("conflict")),
        "km": haversine_m(a("latitude"), a("longitude"), b("latitude"), b("longitude")) / 1000,
    }
    x = x.select(F.col("right_id").alias("incoming"), F.col("left_id").alias("existing"), "conflict", *[v.alias(n) for n, v in e.items()])
    named = {n: F.col(n) for n in [*e, "conflict"]}
    return x.withColumns({"score": F.round(evidence_total(named), 6), "said": decisive_evidence(named)}).select("*", "said.verdict", F.col("said.evidence").alias("decisive")).drop("said")


@query("op_er_03_pair_evidence", with_("geo_entity", _EVIDENCE + """
SELECT incoming, existing, round(name, 6) AS name, round(semantic, 6) AS semantic, round(members, 6) AS members, round(roles, 6) AS roles, round(concept, 6) AS concept, source, relation, score, verdict, decisive,
 concat_ws(',', CASE WHEN name = 1 THEN 'same_normalized_name' WHEN name >= 72e-2 THEN 'similar_name' END, CASE WHEN members > 0 THEN 'shared_geo_entities' END, CASE WHEN members > 0 AND standalone THEN 'standalone_composite_shared_membership' END, CASE WHEN roles > 0 THEN 'shared_role_aware_components' END,
  CASE WHEN km <= 1.5 THEN 'geographically_close' END, CASE WHEN provenance > 0 THEN 'shared_provenance' END, CASE WHEN concept > 0 THEN 'shared_concept_evidence' END, CASE WHEN conflict THEN 'conflicting_evidenced_order' END) AS reasons FROM decided"""))
def pair_evidence(spark, sf):
    """All that speaks for or against two compositions being one."""
    rules = {
        "shared_geo_entities": F.col("members") > 0, "standalone_composite_shared_membership": (F.col("members") > 0) & F.col("standalone"), "shared_role_aware_components": F.col("roles") > 0, "geographically_close": F.col("km") <= 1.5,
        "shared_provenance": F.col("provenance") > 0, "shared_concept_evidence": F.col("concept") > 0, "conflicting_evidenced_order": F.col("conflict"),
    }
    name = F.when(F.col("name") == 1, "same_normalized_name").when(F.col("name") >= 0.72, "similar_name")
    shares = [F.round(n, 6).alias(n) for n in ("name", "semantic", "members", "roles", "concept")]
    return _judged(spark, sf).select("incoming", "existing", *shares, "source", "relation", "score", "verdict", "decisive", F.concat_ws(",", name, *[F.when(v, n) for n, v in rules.items()]).alias("reasons"))


@query("op_er_01_dedupe_decision", with_("geo_entity", _EVIDENCE + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY incoming, verdict ORDER BY score DESC, existing) AS n FROM decided),
g AS (SELECT incoming, arg_min(existing, n) FILTER (verdict = 'SAME') AS canonical, string_agg(existing, ',' ORDER BY n) FILTER (verdict = 'AMBIGUOUS' AND n <= 5) AS candidates FROM ranked GROUP BY 1)
SELECT o_orderkey AS incoming, CASE WHEN canonical IS NOT NULL THEN 'SAME' WHEN candidates IS NOT NULL THEN 'AMBIGUOUS' ELSE 'NEW' END AS decision, canonical, CASE WHEN canonical IS NULL THEN candidates END AS candidates FROM orders LEFT JOIN g ON incoming = o_orderkey"""))
def dedupe_decision(spark, sf):
    """Each tour against the earlier ones: the best SAME, else up to five that can't be told apart (the feature's limit),
    else NEW, as are those that nothing was compared with."""
    order = Window.partitionBy("incoming", "verdict").orderBy(F.desc("score"), "existing")
    best = _judged(spark, sf).select("incoming", "existing", "verdict", "score").withColumn("n", F.row_number().over(order)).where("n <= 5 and verdict <> 'DISTINCT'")
    unsure = F.sort_array(F.collect_list(F.when(F.col("verdict") == "AMBIGUOUS", F.struct("n", "existing"))))
    g = best.groupBy("incoming").agg(F.min_by("existing", F.when(F.col("verdict") == "SAME", F.col("n"))).alias("canonical"), F.array_join(F.transform(unsure, lambda v: v["existing"].cast("string")), ",").alias("unsure"))
    all_ = c.read(spark, sf, "orders").select(F.col("o_orderkey").alias("incoming")).join(g, "incoming", "left")
    decision = F.when(F.col("canonical").isNotNull(), "SAME").when(F.col("unsure") != "", "AMBIGUOUS").otherwise("NEW")
    return all_.select("incoming", decision.alias("decision"), "canonical", F.when(decision == "AMBIGUOUS", F.col("unsure")).alias("candidates"))


@query("op_er_19_reconciliation", with_("component", """, seen AS (SELECT experience_id, position, unnest([CASE WHEN (experience_id + entity_id) % 3 = 0 THEN NULL WHEN experience_id * entity_id % 211 = 5 THEN entity_id + 1 ELSE entity_id END, CASE WHEN experience_id * entity_id % 223 = 7 THEN entity_id + 2 END]) AS e FROM component),
o AS (SELECT experience_id, position, count(DISTINCT e) AS n, max(e) AS e FROM seen GROUP BY ALL),
m AS (SELECT *, n > 1 OR n = 1 AND state = 'RESOLVED' AND e <> entity_id AS conflict, n = 1 AND state <> 'RESOLVED' AS news FROM component JOIN o USING (experience_id, position)),
g AS (SELECT experience_id, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (NOT conflict AND news AND (experience_id + entity_id) % 26 <> 0) AS learned, count(*) FILTER (NOT conflict AND news AND (experience_id + entity_id) % 26 = 0) AS revoked FROM m GROUP BY 1)
SELECT experience_id, CASE WHEN experience_id % 7 = 0 OR experience_id % 13 = 0 OR experience_id % 17 = 0 THEN 'NOT_ELIGIBLE' WHEN conflicts > 0 THEN 'CONFLICT_REJECTED' WHEN learned > 0 THEN 'ENRICHED' ELSE 'NO_NEW_KNOWLEDGE' END AS outcome,
 CASE WHEN experience_id % 7 = 0 THEN 'NOT_SAME_EXACT_COMPOSITION' WHEN experience_id % 13 = 0 THEN 'LEGACY_MEMBER_WITHOUT_SOURCE_POSITION' WHEN experience_id % 17 = 0 THEN 'INCOMPLETE_MEMBER_CORRESPONDENCE' END AS reason,
 CASE WHEN experience_id % 7 = 0 OR experience_id % 13 = 0 OR experience_id % 17 = 0 OR conflicts > 0 THEN 0 ELSE learned END AS learned, CASE WHEN experience_id % 7 = 0 OR experience_id % 13 = 0 OR experience_id % 17 = 0 THEN 0 ELSE revoked END AS revoked FROM g"""))
def reconciliations(spark, sf):
    """A second reading of a stored composition fills its unresolved members, unless any member contradicts it; members
    whose resolution was revoked aren't learnt again."""
    k, e = F.col("experience_id"), F.col("entity_id")
    first = F.when((k + e) % 3 == 0, F.lit(None)).when(k * e % 211 == 5, e + 1).otherwise(e)
    second = F.when(k * e % 223 == 7, e + 2)
    observed = F.array_distinct(F.array_compact(F.array(first, second)))
    resolved = F.col("state") == "RESOLVED"
    m = c.component(spark, sf).select(k, e, resolved.alias("resolved"), observed.alias("seen"))
    one = F.size("seen") == 1
    conflict = (F.size("seen") > 1) | (one & F.col("resolved") & ~F.array_contains("seen", e))
    news, revoked = one & ~F.col("resolved") & ~conflict, (k + e) % 26 == 0
    g = m.groupBy(k).agg(F.count_if(conflict).alias("conflicts"), F.count_if(news & ~revoked).alias("learned"), F.count_if(news & revoked).alias("revoked"))
    same, positioned, covered = k % 7 != 0, k % 13 != 0, k % 17 != 0
    reason = F.when(~same, "NOT_SAME_EXACT_COMPOSITION").when(~positioned, "LEGACY_MEMBER_WITHOUT_SOURCE_POSITION").when(~covered, "INCOMPLETE_MEMBER_CORRESPONDENCE")
    outcome = reconciliation(same, positioned, covered, F.col("conflicts"), F.col("learned"))
    learned, kept = F.when(outcome == "ENRICHED", F.col("learned")).otherwise(0), F.when(outcome == "NOT_ELIGIBLE", 0).otherwise(F.col("revoked"))
    return g.select(k, outcome.alias("outcome"), reason.alias("reason"), learned.cast("long").alias("learned"), kept.cast("long").alias("revoked"))


@query("op_er_25_resolution_coverage", with_("component geo_entity", f""", m AS (SELECT experience_id, entity_id, state = 'RESOLVED' AS resolved, (experience_id * 31 + entity_id * 7) % 10 AS r, {_ring_sql(AREA[0])} AND NOT {_ring_sql(AREA[1])} AS inside FROM component JOIN geo_entity USING (entity_id))
SELECT experience_id, count(*) AS total, count(*) FILTER (resolved) AS resolved, count(*) FILTER (resolved AND inside) AS accepted, count(*) FILTER (NOT resolved AND r NOT IN (3, 4)) AS unresolved, count(*) FILTER (NOT resolved AND r = 3) AS ambiguous, count(*) FILTER (NOT resolved AND r = 4) AS conflicted,
 round(count(*) FILTER (resolved) / count(*), 6) AS ratio, coalesce(string_agg(entity_id, ',' ORDER BY entity_id) FILTER (NOT resolved AND r = 3), '') AS open_deficits, bool_and(resolved) AS complete FROM m GROUP BY 1"""))
def resolution_coverage(spark, sf):
    """How much of each composition is known, how much of that lies in the area, and what is still to be looked for."""
    at = ((F.col("experience_id") * 31 + F.col("entity_id") * 7) % len(DEFICITS) + 1).cast("int")
    reason, resolved = F.element_at(F.array(*map(F.lit, DEFICITS)), at), F.col("state") == "RESOLVED"
    status = F.when(resolved, "RESOLVED").when(reason == "AMBIGUOUS_CANDIDATES", "AMBIGUOUS").when(reason == "IDENTITY_CONFLICT", "CONFLICTED").otherwise("UNRESOLVED")
    m = c.component(spark, sf).join(c.geo_entity(spark, sf), "entity_id")
    m = m.select("experience_id", "entity_id", status.alias("status"), F.when(~resolved, deficit_class(reason)).alias("deficit"), in_polygon(F.col("latitude"), F.col("longitude"), AREA).alias("inside"))
    n = lambda s: F.count_if(F.col("status") == s)
    open_ = F.sort_array(F.collect_list(F.when(F.col("deficit") == "KNOWLEDGE_DEFICIT", F.col("entity_id"))))
    g = m.groupBy("experience_id").agg(F.count("*").alias("total"), n("RESOLVED").alias("resolved"), F.count_if((F.col("status") == "RESOLVED") & F.col("inside")).alias("accepted"), n("UNRESOLVED").alias("unresolved"), n("AMBIGUOUS").alias("ambiguous"), n("CONFLICTED").alias("conflicted"), open_.alias("open"))
    return g.select("*", F.round(F.col("resolved") / F.col("total"), 6).alias("ratio"), F.array_join(F.transform("open", lambda v: v.cast("string")), ",").alias("open_deficits"), (F.col("resolved") == F.col("total")).alias("complete")).drop("open")
