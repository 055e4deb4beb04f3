"""Wiki templates against a plain parser, merged metadata against the rule applied pair by pair in any order."""

import json
import random
import re

from wayloom.operators.merging import SHAPE, merged
from wayloom.operators.templates import LISTINGS, listings, parameters, parsed, templates
from wayloom.plans import catalog
from wayloom.plans.gathered import metadata, pages


def brute_templates(text):
    """Outermost named templates by trying every opening: braces in pairs from the left, counted to the one that closes it."""
    marks = [(m.start(), m[0]) for m in re.finditer(r"\{\{|\}\}", text)]
    out, far = [], -1
    for k, (a, what) in enumerate(marks):
        name = re.match(r"([a-zA-ZáéíóúÁÉÍÓÚ_]+)[\s|}]", text[a + 2 :])
        if what == "}}" or a < far or not name:
            continue
        depth = 0
        for b, other in marks[k:]:
            depth += 1 if other == "{{" else -1
            if depth == 0:
                out.append((a, b + 2, name[1].lower()))
                far = b + 2
                break
    return out


def test_templates_equal_a_plain_parse():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(["{{see|", "{{do ", "{{", "}}", "}}", "name=a", "|", "x", "[[", "]]", "{", "}", "{{9|", " "]) for _ in range(rng.randrange(25)))
        assert templates(text) == brute_templates(text), text
    deep = "{{see|" * 2000 + "name=x" + "}}" * 2000
    assert templates(deep) == [(0, len(deep), "see")] and templates("{{see|" * 20000) == [] and templates("}}" * 5) == []


def test_parameters_part_at_outer_bars():
    assert parameters("see|name=[[a|b]]|Lat = 1 | content={{x|y=2}}|z|name = last|url=a=b") == {"name": "last", "lat": "1", "content": "{{x|y=2}}", "url": "a=b"}
    row = next(parsed("{{Ver|nombre=''A''  &quot;b&quot; [[File:x.png|thumb]]|lat=+.5|long=181|wikidata=see q12}}"))
    assert (row["name"], row["latitude"], row["longitude"], row["wikidata"], row["section"]) == ("''A'' \"b\"", 0.5, None, "Q12", "SEE")
    drops = [r["dropped"] for r in parsed("{{see}} {{do|name=}} {{eat|name=<b></b>}} {{box|name=a}} {{listing|type=x|name=a}}")]
    assert drops == ["MISSING_NAME", "EMPTY_NAME", "EMPTY_NAME", "UNSUPPORTED", None]
    sections = [r["section"] for r in parsed("{{listing|name=a}} == Dónde comer == {{listing|name=b}} {{listado|tipo=DO|name=c}} === x === {{listing|name=d}}")]
    assert sections == ["OTHER", "EAT", "DO", "OTHER"]


def test_listings_and_audit_agree_with_the_pages(spark, sf):
    texts = {r.doc_id: r.text for r in pages(spark, sf).collect()}
    rows = listings(pages(spark, sf)).collect()
    want = {(d, k, a, n) for d, t in texts.items() for k, (a, _, n) in enumerate(brute_templates(t), 1)}
    assert {(r.doc_id, r.ordinal, r.start, r.template) for r in rows} == want and len(rows) == len(want)
    found = {(r.doc_id, r.ordinal): r for r in catalog.QUERIES["op_src_15_wiki_listings"](spark, sf).collect()}
    assert set(found) == {(r.doc_id, r.ordinal) for r in rows if r.dropped is None} and {r.section for r in found.values()} >= {"SEE", "DO", "EAT"}
    for r in catalog.QUERIES["op_src_15_wiki_audit"](spark, sf).collect():
        own = [x for x in rows if x.doc_id == r.doc_id]
        assert r.recognised == sum(x.template in LISTINGS for x in own) and r.parsed == r.see + r.do + r.eat + r.other and r.recognised == r.parsed + r.missing_name + r.empty_name and r.unsupported == len(own) - r.recognised
    assert listings(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


def pair(a, b):
    """Two metadata records into one, by the rules."""
    tidy = lambda v: {x.strip().lower() for x in (v or []) if x and x.strip()}
    out = {"id": a["id"]}
    scores = [q for q in (a["quality"], b["quality"]) if q is not None and q == q and 0 <= q <= 5]
    out["quality"] = max(scores) if scores else None
    for f in ("themes", "intents", "traits"):
        out[f] = sorted(tidy(a[f]) | tidy(b[f]))
    labels = {}
    for d in (a["dimensioned"] or []) + (b["dimensioned"] or []):
        if d["dimension"] and d["dimension"].strip() and d["key"] and d["key"].strip():
            at = (d["dimension"].strip().lower(), d["key"].strip().lower())
            labels.setdefault(at, [])
            if d["label"] and d["label"].strip():
                labels[at].append(d["label"].strip())
    out["dimensioned"] = [{"dimension": x, "key": y, "label": min(labels[x, y], key=lambda s: (-len(s), s), default=None)} for x, y in sorted(labels, key=":".join)]
    rank = {"current": 2, "degraded": 1}
    said = [c for c in (a["classification"], b["classification"]) if c and rank.get(c["state"])]
    out["classification"] = min(said, key=lambda c: (-rank[c["state"]], -len(c["evidence"] or []), json.dumps(c, separators=(",", ":"))), default=None)
    values = {}
    for m in (a["other"] or {}, b["other"] or {}):
        for k, v in m.items():
            if v and v.strip():
                values[k] = min([v, *([values[k]] if k in values else [])], key=lambda s: (-len(s), s))
    return out | {"other": values}


def told(rows):
    return {r["id"]: r | {"dimensioned": r["dimensioned"], "other": dict(sorted(r["other"].items()))} for r in rows}


def test_merge_equals_pairs_in_any_order_and_partitioning(spark, sf):
    rows = [r.asDict(recursive=True) for r in metadata(spark, sf).where("id < 60").collect()]
    rows += [{"id": 900, "quality": None, "themes": None, "intents": None, "traits": [None], "dimensioned": None, "classification": None, "other": None}, {"id": 901, "quality": float("nan"), "themes": [], "intents": [" "], "traits": [], "dimensioned": [], "classification": None, "other": {}}]
    rng, want = random.Random(3), {}
    for seed in range(3):
        rng.shuffle(rows)
        folded = {}
        for r in rows:
            folded[r["id"]] = pair(folded[r["id"]], r) if r["id"] in folded else pair(r, r)
        assert not want or told(folded.values()) == want  # the rule itself doesn't see the order
        want = told(folded.values())
        frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in ("id", "quality", "themes", "intents", "traits", "dimensioned", "classification", "other")) for r in rows], SHAPE).repartition(seed * 3 + 1)
        assert told(r.asDict(recursive=True) for r in merged(frame).collect()) == want
    halves = merged(frame.where("quality > 2")).unionByName(merged(frame.where("quality <= 2 or quality is null")))
    assert told(r.asDict(recursive=True) for r in merged(halves).collect()) == want
    assert merged(frame.limit(0)).count() == 0


def test_merge_query_covers_all_experiences(spark, sf):
    rows = catalog.QUERIES["op_agg_16_metadata_merge"](spark, sf).collect()
    assert len(rows) == metadata(spark, sf).select("id").distinct().count() and all(r.classification is None or '"state":"current"' in r.classification or "degraded" in r.classification for r in rows)


def test_day_totals_are_exact_in_any_order(spark, tmp_path):
    """A half rounds up, whose sum of doubles is below it in some orders and not in others."""
    from itertools import permutations
    from math import floor

    prices = (81574.79, 12635.26, 11402.45)
    lines = [(n, 1, 1.0, p) for n, order in enumerate(permutations(prices)) for p in order]
    assert {floor((a + b) + c + 0.5) for a, b, c in permutations(prices)} == {105612, 105613}
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["op_agg_04_day_totals"](spark, str(tmp_path)).collect()
    assert {(r.stops, r.seconds, r.metres) for r in got} == {(3, 180, 105613)}


def test_candidate_pool_of_few_and_of_many_sharers(spark, tmp_path):
    """Parts with fewer others than 50, with a key of just 50, 51 and 52 parts, and with many keys of a few."""
    import duckdb

    part = [(i, "Same" if i < 52 else "same two" if i < 103 else "three" if i < 153 else f"own {i}") for i in range(400)]
    lines = [(i, i % 7) for i in range(0, 400, 3)] + [(i, 100 + i // 4) for i in range(400)] + [(399, s) for s in range(100, 200, 2)] + [(500, 900)]
    spark.createDataFrame(part, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    frame = catalog.QUERIES["op_join_10_candidate_pool"](spark, str(tmp_path))
    assert sorted(map(tuple, frame.select("a", "b", "rank").collect())) == sorted(con.execute(catalog.SQL["op_join_10_candidate_pool"]).fetchall())
