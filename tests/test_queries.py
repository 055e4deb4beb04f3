"""Every query against its SQL, and properties of those that SQL can't express."""

import math

import pandas as pd
import pytest

from wayloom.plans import catalog, identity, ranking


def same(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or not hasattr(v, "__float__"):
        return str(v)
    return f"{float(v):.5f}"


def rows(frame):
    return sorted((tuple(same(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def pools(spark, sf):
    rows = ranking.pool(spark, sf).toPandas()
    musts = {r.request_id: r.experience_id for r in ranking.must(spark, sf).collect()}
    return {k: (g.to_dict("records"), musts[k]) for k, g in rows.groupby("request_id")}


def number(v):
    return -math.inf if v is None or pd.isna(v) else v


def plain_composition(rows, must, facets):
    """The rules over the whole pool, by sorting it anew for every choice."""
    weight = dict(facets)
    by = lambda keys: lambda r: (*(-number(r[k]) if k != "cover" else -sum(w for f, w in facets if f in r["facets"]) for k in keys), str(r["experience_id"]))
    chosen = [(must, "MUST")]
    taken = {must}
    has = {r["experience_id"]: set(r["facets"]) for r in rows}
    for f in weight:
        if any(f in has[i] for i, _ in chosen):
            continue
        fits = sorted((r for r in rows if r["experience_id"] not in taken and f in has[r["experience_id"]]), key=by(("grounding", "semantic", "quality", "tilt", "boost")))
        if fits:
            chosen.append((fits[0]["experience_id"], "RESERVED"))
            taken.add(fits[0]["experience_id"])
    target = max(max(1, min(rows[0]["days"], 14)) * {"relaxed": 3, "moderate": 4, "fast": 5}[rows[0]["pace"]], len(chosen))
    rest = sorted((r for r in rows if r["experience_id"] not in taken), key=by(("cover", "semantic", "quality", "tilt", "boost")))
    return chosen + [(r["experience_id"], "FILL") for r in rest[: target - len(chosen)]]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_composition_equals_the_rules_on_whole_pools(spark, sf_dir):
    got = catalog.QUERIES["op_rank_06_composition"](spark, sf_dir).toPandas().sort_values(["request_id", "position"])
    found = {k: list(zip(g["experience_id"], g["reason"], strict=True)) for k, g in got.groupby("request_id")}
    want = {k: plain_composition(rows, must, [(f, w) for i, _, f, w in ranking.WANTED if i == k]) for k, (rows, must) in pools(spark, sf_dir).items()}
    assert found == want and any(len(rows) > 200 for rows, _ in pools(spark, sf_dir).values()) == (sf_dir[-4:] == "0.01")


def test_diversity_equals_the_rules_on_whole_pools(spark, sf):
    rows = ranking.scored(spark, sf).toPandas()
    got = catalog.QUERIES["op_rank_03_diversity"](spark, sf).toPandas().sort_values(["request_id", "rank"])
    for k, g in rows.groupby("request_id"):
        rest, kinds, subtypes, want = g.to_dict("records"), set(), [], []
        while rest:
            def key(r):
                n = subtypes.count(r["subtype"])
                score = r["base"] + (0.0 if r["kind"] in kinds else 0.04) + (0.03 if n == 0 else 0.0) - min(0.1, n * 0.02)
                return (-r["preference"], -score, -r["bonus"], r["km"], r["experience_id"])

            best = min(rest, key=key)
            rest.remove(best)
            kinds.add(best["kind"])
            subtypes.append(best["subtype"])
            want.append(best["experience_id"])
        assert got[got["request_id"] == k]["experience_id"].tolist() == want


def test_diversity_groups_hold_what_is_open(spark, tmp_path, monkeypatch):
    """Long lists of a few kinds and subtypes, without some of them, in tiers of one request and another: every rank and score is
    the rule's, and a group holds five candidates of a list at most, however long it is."""
    import random

    from wayloom.operators import planning
    from wayloom.sources.shared import Tables

    draw, whole = random.Random(7), planning.diversify

    def few(pool):
        assert len(pool) <= 5 * len(pool.groupby(["preference", "kind", "subtype"], dropna=False)) < 400
        return whole(pool)

    monkeypatch.setattr(planning, "diversify", few)
    rows = [(draw.choice([1, 1, 1, 2]), i, draw.choice([0.0, 0.3, 1.0]), draw.randrange(80) / 1000, draw.choice([0.0, 0.1]), draw.randrange(3) / 2, draw.choice(["a", "b", None]), draw.choice(["u", "v", "w", "x", None])) for i in range(1500)]
    rows += [(3, i, None if i % 2 else 0.0, 0.5, 0.0, 1.0, "a", f"s{i % 3}") for i in range(40)]
    pool = spark.createDataFrame(rows, "request_id int, experience_id long, preference double, base double, bonus double, km double, kind string, subtype string")
    got = planning.diversified(pool, Tables(spark, "diversity")).collect()
    want = []
    for q in (1, 2, 3):
        rest, kinds, counts, rank = [r for r in rows if r[0] == q], set(), {}, 0
        while rest:
            def key(r):
                n = counts.get(r[7], 0)
                return (-(r[2] or 0.0), -(r[3] + (0.0 if r[6] in kinds else 0.04) + (0.03 if n == 0 else 0.0) - min(0.1, n * 0.02)), -r[4], r[5], r[1])

            best, rank = min(rest, key=key), rank + 1
            want.append((q, rank, best[1], round(-key(best)[1], 6)))
            rest.remove(best)
            kinds.add(best[6])
            counts[best[7]] = counts.get(best[7], 0) + 1
    assert sorted(map(tuple, got)) == want


def test_scored_candidates_broadcast_constants_only(spark, sf):
    """The lists of what is wanted, twice, and a row per request: no table that grows."""
    plan = ranking.scored(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 3 and "Window" not in plan


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_placement_equals_the_rules_on_whole_pools(spark, sf_dir):
    got = catalog.QUERIES["op_plan_05_day_placement"](spark, sf_dir).toPandas()
    for k, g in ranking.relevant(spark, sf_dir).toPandas().groupby("request_id"):
        days, most = max(1, min(g["days"].iat[0], 14)), {"relaxed": 3, "moderate": 4, "fast": 5}[g["pace"].iat[0]]
        used, plan = [[] for _ in range(days)], []
        for r in sorted(g.to_dict("records"), key=lambda r: (-r["relevance"], r["experience_id"])):
            fits = [d for d in range(days) if len(used[d]) < most and sum(used[d]) + r["duration_minutes"] <= 660]
            if fits:
                d = min(fits, key=lambda d: (len(used[d]), d))
                plan.append((d + 1, len(used[d]) + 1, r["experience_id"], 540 + sum(used[d]), 540 + sum(used[d]) + r["duration_minutes"]))
                used[d].append(r["duration_minutes"])
        own = got[got["request_id"] == k]
        assert sorted(plan) == sorted(zip(own["day"], own["position"], own["experience_id"], own["start_minute"], own["end_minute"], strict=True))


def test_complete_link_equals_the_rule_over_all_pairs(spark, sf):
    same = {(r.left_id, r.right_id) for r in identity.decisions(spark, sf).where("decision = 'SAME'").collect()}
    clusters = []
    for i in sorted(r.id for r in identity.proposals(spark, sf).select("id").collect()):
        fits = [m for m in clusters if all((j, i) in same for j in m)]
        if len(fits) == 1:
            fits[0].append(i)
        else:
            clusters.append([i])
    got = {r.id: r.cluster for r in catalog.QUERIES["op_er_11_complete_link"](spark, sf).collect()}
    assert got == {i: m[0] for m in clusters for i in m}


def test_pushdown_reaches_the_scan(spark, sf):
    plan = catalog.QUERIES["op_agg_02_count_where"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "l_returnflag" in plan.split("ReadSchema")[-1] and "l_comment" not in plan
