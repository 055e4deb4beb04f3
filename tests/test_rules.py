"""Decision tables, rings, statements and segments against plain twins, with rows that the tables don't hold."""

import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions.policy import decisive_evidence, qid, quotable, source_document, span_support, statements, visible_heading
from wayloom.functions.rules import IDENTITY_RULES, identity_verdict, opening_week, repair_json, route_variant
from wayloom.operators.rings import close_rings, stitch
from wayloom.plans import catalog


def column(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_decisive_evidence(spark):
    base = dict(name=0.1, members=0.2, roles=0.1, concept=0.0, conflict=False, standalone=False, source="SOURCE_UNKNOWN", relation="PARTIAL_OVERLAP")
    cases = [
        (dict(relation="EXACT_COMPOSITION", roles=1.0, concept=1.0), "SAME", "EXACT_COMPOSITION_IDENTITY_CONFIRMED"), (dict(relation="EXACT_COMPOSITION", roles=1.0, name=1.0), "SAME", "EXACT_COMPOSITION_IDENTITY_CONFIRMED"),
        (dict(relation="EXACT_COMPOSITION", roles=1.0, name=1.0, conflict=True), "AMBIGUOUS", "EXACT_COMPOSITION_IDENTITY_UNCONFIRMED"), (dict(relation="EXACT_COMPOSITION", roles=0.9, name=1.0), "AMBIGUOUS", "EXACT_COMPOSITION_IDENTITY_UNCONFIRMED"),
        (dict(relation="DISJOINT", name=0.72), "AMBIGUOUS", "SIMILAR_NAME_WITHOUT_SHARED_STRUCTURE"), (dict(relation="DISJOINT"), "DISTINCT", "STRUCTURALLY_DISJOINT"),
        (dict(relation="SUBCOMPOSITION", name=0.8), "AMBIGUOUS", "STRUCTURAL_OVERLAP_WITH_SIMILAR_NAME"), (dict(relation="SUBCOMPOSITION", members=0.9, source="SAME_SOURCE"), "DISTINCT", "SUBCOMPOSITION_SAME_SOURCE_CONTAINMENT"),
        (dict(relation="SUBCOMPOSITION", standalone=True, source="SAME_SOURCE"), "DISTINCT", "STANDALONE_COMPOSITE_MEMBERSHIP"), (dict(members=0.5), "AMBIGUOUS", "PARTIAL_OVERLAP_IDENTITY_UNRESOLVED"),
        (dict(roles=0.4), "AMBIGUOUS", "PARTIAL_OVERLAP_IDENTITY_UNRESOLVED"), (dict(members=0.9, standalone=True), "DISTINCT", "STANDALONE_COMPOSITE_MEMBERSHIP"), ({}, "DISTINCT", "PARTIAL_OVERLAP_INSUFFICIENT"),
    ]
    rows = spark.createDataFrame([(i, *(base | d).values()) for i, (d, _, _) in enumerate(cases)], "i int, name double, members double, roles double, concept double, conflict boolean, standalone boolean, source string, relation string")
    got = rows.select("i", decisive_evidence({n: F.col(n) for n in base}).alias("v")).orderBy("i").collect()
    assert [(r.v.verdict, r.v.evidence) for r in got] == [(v, e) for _, v, e in cases]


@pytest.mark.parametrize("seed", range(20))
def test_cut_rings_close_again(seed):
    r = random.Random(seed)
    ways, want = [], []
    for n in range(r.randint(1, 4)):
        ring = [(n * 10 + r.random(), r.random()) for _ in range(r.randint(3, 12))]
        cuts = sorted(r.sample(range(1, len(ring)), r.randint(1, len(ring) - 1)))
        closed = [*ring[cuts[0]:], *ring[: cuts[0]], ring[cuts[0]]]
        at = [0, *(c - cuts[0] for c in cuts[1:]), len(ring)]
        parts = [closed[a : b + 1] for a, b in zip(at[:-1], at[1:], strict=True)]
        ways += [p[::-1] if r.random() < 0.5 else p for p in parts]
        want.append(frozenset(ring))
    r.shuffle(ways)
    got = close_rings([*ways, [(99.0, 99.0)], [(50.0, 50.0), (51.0, 50.0)]])
    assert sorted(map(sorted, map(frozenset, got))) == sorted(map(sorted, want))
    for ring in got:
        steps = {frozenset(e) for w in ways for e in zip(w[:-1], w[1:], strict=True)}
        assert ring[0] == ring[-1] and all(frozenset(e) in steps for e in zip(ring[:-1], ring[1:], strict=True))


def test_stitch_takes_nothing(spark):
    kind = "i int, ways array<array<struct<x:double,y:double>>>"
    rows = spark.createDataFrame([(0, None), (1, []), (2, [[]]), (3, [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (0.0, 0.0)]])], kind)
    assert [len(r.v) for r in rows.select("i", stitch("ways").alias("v")).orderBy("i").collect()] == [0, 0, 0, 1]


def test_texts(spark):
    said = column(spark, ["# Head\nOne. Two!  Three?no", "a ![pic one](x.png) b [link](u) *c*", "甲。乙！丙", "x.  y", " \n.. !", "", None], statements)
    assert said == [["Head", "One.", "Two!", "Three?no"], ["a", "pic one", "b link c"], ["甲。", "乙！", "丙"], ["x.", "y"], [], [], None]
    assert column(spark, ["### A  *b* ##", "  # [x](y)", "    # code", "#no", None], visible_heading) == ["A b", "x", "# code", "#no", None]
    assert column(spark, ['The "**Old** [Mill](u)" , a', None], quotable) == ['the"old mill", a', None]
    assert column(spark, ["Q12", " Q1 ", "Q0", "Q1;Q2", None], qid) == ["Q12", "Q1", None, None, None]
    assert column(spark, ["HTTP://Ex.ORG/A/#b", "https://e.org/", "no url#x", None], source_document) == ["http://ex.org/A", "https://e.org", "no url#x", None]


def test_span_support(spark):
    rows = spark.createDataFrame([("", None, False, 0), ("x", 2, True, 5), ("x", None, True, 1), ("x", None, False, 3), ("x", None, True, 0), ("x", None, False, 0)], "span string, cited int, seen boolean, n int")
    got = [r.v for r in rows.select(span_support(F.col("span"), F.col("cited"), F.col("seen"), F.col("n")).alias("v")).collect()]
    assert got == ["NO_SUPPORT_SPAN", "DECLARED_KEY_VERIFIED", "REATTRIBUTED_UNIQUE_EXACT_SPAN", "AMBIGUOUS_SUPPORTING_EVIDENCE", "SPAN_NOT_FOUND_IN_CITED_EVIDENCE", "MISSING_EVIDENCE_TEXT"]


def test_segments_equal_a_walk_over_the_atoms(spark, sf, duck):
    atoms = duck.sql("select l_orderkey doc, l_linenumber atom, max(l_partkey) k from lineitem group by all order by 1, 2").fetchall()
    names = dict(duck.sql("select p_partkey, lower(p_name) from part").fetchall())
    want, doc = [], None
    for d, atom, k in atoms:
        role = [None, "PASS_BY", "ALTERNATIVE", "COMPONENT", "COMPONENT"][k % 5]
        if d != doc:
            doc, run = d, False
            want.append([d, 1, atom, atom, 0, set(), 0, False])
        if k % 3 == 0:
            run = False
            if want[-1][7]:
                want.append([d, want[-1][1] + 1, atom, atom, 0, set(), 0, False])
            want[-1][4] += 1
        s = want[-1]
        s[3] = atom
        if role:
            s[5].add(names[k])
            s[7] |= role != "PASS_BY"
            s[6] += role == "ALTERNATIVE" and not run
            run = role == "ALTERNATIVE"
    got = catalog.QUERIES["op_txt_07_segments"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((*s[:5], len(s[5]), *s[6:]) for s in want)


EVIDENCE = {
    "contradiction": ("", "FOUND"), "route": ("", "MULTIPLE_CLUSTERS", "COMPATIBLE", "INCOMPATIBLE"), "variant": ("", "SINGLE", "MULTIPLE", "UNKNOWN"), "hint": ("", "SINGLE", "MULTIPLE", "UNKNOWN"), "contextual": ("", "DISTINGUISHED", "AMBIGUOUS"),
    "declared": ("", "FOUND"), "address": ("", "FOUND"), "competitors": ("", "MATERIAL_COMPETITOR_KNOWN", "NO_MATERIAL_COMPETITOR", "NO_COMPETITOR_OBSERVED"), "wikidata_source": ("", "LINK", "NEARBY"), "wikidata_role": ("CORROBORATING", "CONTRADICTORY", "NEUTRAL"),
    "correspondence": ("", "ADMISSION_SCOPE_ONLY", "POINT_IN_AREA"), "convergence": ("", "CORROBORATING", "NEUTRAL"), "name": ("", "SINGLE", "MULTIPLE", "UNKNOWN"), "alias": ("", "SINGLE", "MULTIPLE", "UNKNOWN"), "alias_role": ("CORROBORATING", "NEUTRAL"), "wikidata_unavailable": ("", "FOUND"),
}


def plain_identity(e):
    """The decision as nested questions, from what is strongest to what is missing."""
    if e["contradiction"]:
        return "REJECTED", "IDENTITY_CONTRADICTION"
    if e["route"] in ("MULTIPLE_CLUSTERS", "COMPATIBLE"):
        return ("AMBIGUOUS" if e["route"] == "MULTIPLE_CLUSTERS" else "VERIFIED"), "STRUCTURED_ROUTE"
    for field, rule, good, bad in (("variant", "CATALOG_ROUTE_VARIANT", "SINGLE", "MULTIPLE"), ("hint", "CATALOG_VERIFIED_HINT", "SINGLE", "MULTIPLE"), ("contextual", "CONTEXTUAL_CORRESPONDENCE", "DISTINGUISHED", "AMBIGUOUS")):
        if e[field] in (good, bad):
            return ("VERIFIED" if e[field] == good else "AMBIGUOUS"), rule
    for field, rule in (("declared", "SOURCE_DECLARED_IDENTITY"), ("address", "ADDRESS_MATCH")):
        if e[field]:
            return "VERIFIED", rule
    if e["competitors"] == "MATERIAL_COMPETITOR_KNOWN":
        return "AMBIGUOUS", "MATERIAL_COMPETITOR_KNOWN"
    linked, agrees = e["wikidata_source"], e["wikidata_role"] == "CORROBORATING"
    if linked == "LINK" and agrees:
        return "VERIFIED", "QID_LINK"
    collides = "MULTIPLE" in (e["name"], e["alias"])
    if e["correspondence"] == "POINT_IN_AREA":
        if e["convergence"] == "CORROBORATING" and e["competitors"] == "NO_MATERIAL_COMPETITOR":
            return "VERIFIED", "GROUNDED_CONVERGENCE"
        if e["name"] == "SINGLE":
            return "VERIFIED", "GROUNDED_UNIQUE_EXACT_NAME"
        if e["alias"] == "SINGLE" and e["alias_role"] == "CORROBORATING":
            return "VERIFIED", "GROUNDED_UNIQUE_ALIAS"
        if linked and agrees and not (collides and linked == "NEARBY"):
            return "VERIFIED", "WIKIDATA_CORROBORATION"
    if linked and collides:
        return "AMBIGUOUS", "NAME_COLLISION"
    if linked and e["wikidata_role"] == "CONTRADICTORY":
        return "REJECTED", "QID_LINK_MISMATCH"
    if e["wikidata_unavailable"]:
        return "INSUFFICIENT_EVIDENCE", "WIKIDATA_UNAVAILABLE"
    if collides:
        return "AMBIGUOUS", "NAME_COLLISION"
    return "INSUFFICIENT_EVIDENCE", "NAME_UNIQUENESS_UNKNOWN" if "UNKNOWN" in (e["name"], e["alias"]) else "NO_DECISIVE_EVIDENCE"


def test_identity_rules_reach_every_branch(spark):
    r = random.Random(6)
    cases = [{n: (r.choice(v) if r.random() < p else v[0] if n not in ("wikidata_role", "alias_role") else r.choice(v)) for n, v in EVIDENCE.items()} for p in (0.15, 0.4, 0.8) for _ in range(2500)]
    rows = spark.createDataFrame([(i, *e.values()) for i, e in enumerate(cases)], "i int, " + ", ".join(f"{n} string" for n in EVIDENCE))
    got = {x.i: (x.v.status, x.v.rule) for x in rows.select("i", identity_verdict().alias("v")).collect()}
    assert got == {i: plain_identity(e) for i, e in enumerate(cases)}
    assert {rule for _, rule in got.values()} == {rule for rule, _, _ in IDENTITY_RULES} | {"NO_DECISIVE_EVIDENCE"}


def test_identity_query_reaches_most_rules(spark):
    rules = {r.rule for r in catalog.QUERIES["op_er_16_identity_verdict"](spark, "/root/testdata/sf0.01").collect()}
    assert len(rules) >= 16, rules


def test_designators_whatever_their_accents(spark):
    assert column(spark, ["Callejón del Agua", "CALLEJÓN X", "Callejón Y", "Callejón", "Av. Mayo St.", "North Park"], route_variant) == ["del Agua", "X", "Y", "Callejón", "Mayo", "North Park"]


def test_repair_knows_strings(spark):
    broken = ['{"u": "https://x.org/a", "c": "a, ]", // off\n "n": [1, 2, /* b */ ],}', '{"a": "x /* y */ z", "b": "tab\there\\" , }"}', '{"a": 1, /* open', '{"open', "", None, '{"a": [1,],"b": {"c": 2 , }}']
    want = ['{"u": "https://x.org/a", "c": "a, ]",  "n": [1, 2  ]}', '{"a": "x /* y */ z", "b": "tab\\there\\" , }"}', '{"a": 1, ', '{"open', "", None, '{"a": [1],"b": {"c": 2  }}']
    got = column(spark, broken, repair_json)
    assert [None if g is None else " ".join(g.split()) for g in got] == [None if w is None else " ".join(w.split()) for w in want]


def test_weeks_known_and_unknown(spark):
    weeks = [["Monday: Closed"], ["Sunday 9-5", "x"], [], None, ["Friday: 11:00 PM – 2:00 AM", "Saturday: closed"]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(weeks)], "i int, w array<string>").select("i", opening_week(F.col("w")).alias("v")).orderBy("i").collect()
    told = [None if r.v is None else [(d.weekday, [tuple(x) for x in d.ranges]) for d in r.v] for r in rows]
    assert told == [[(1, [])], None, None, None, [(5, [(1380, 1440)]), (6, [(0, 120)])]]
