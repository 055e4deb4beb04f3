"""Elimination against the rule row by row, correspondence against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators.elimination import eliminated
from wayloom.plans import catalog
from wayloom.plans.more import order_conflict
from wayloom.plans.overlap import candidates, overlapping
from wayloom.sources.shared import Tables


def sequential(order, pairs):
    """Down the list: a row that is still there takes out all later ones that overlap it."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for k, a in enumerate(order):
        if a not in out:
            for b in order[k + 1 :]:
                if b in near.get(a, ()) and b not in out:
                    out[b] = a
    return out


@pytest.mark.parametrize("rounds", [0, 1, 16])
def test_elimination_equals_the_sequential_rule(spark, rounds):
    """Chains down the ranks, a hub, cliques, a random graph, loops, repeated and reversed pairs."""
    rng = random.Random(5)
    rows, pairs, at = [], [], 0
    for n, kind in ((40, "chain"), (60, "hub"), (12, "clique"), (120, "random"), (30, "mixed"), (3, "alone")):
        ids = list(range(at, at + n))
        at += n
        ranks = {i: (k if kind == "chain" else rng.randrange(10)) for k, i in enumerate(ids)}
        rows += [(i, ranks[i]) for i in ids]
        own = {"chain": list(zip(ids[:-1], ids[1:], strict=True)), "hub": [(ids[n // 2], i) for i in ids], "clique": [(i, j) for i in ids for j in ids], "random": [tuple(rng.sample(ids, 2)) for _ in range(200)], "mixed": [(ids[k], ids[k + d]) for k in range(n) for d in (1, 2) if k + d < n], "alone": []}[kind]
        pairs += own + [(b, a) for a, b in own[::3]] + own[::4]
    frame = spark.createDataFrame(rows, "id long, score int")
    tables = Tables(spark, "t")
    got = eliminated(frame, spark.createDataFrame(pairs, "a long, b long"), [(-F.col("score")).alias("s"), F.col("id").alias("i")], tables, rounds)
    order = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert {r.id: r.by for r in got.collect()} == sequential(order, pairs)
    assert eliminated(frame, spark.createDataFrame([], "a long, b long"), [F.col("id").alias("i")], tables).count() == 0
    tables.close()


def test_overlap_filter_equals_the_sequential_rule(spark, sf):
    rows = candidates(spark, sf)[0].collect()
    key = lambda r: (not r.must, -(r.coverage if r.coverage is not None else float("-inf")), -r.n, -r.score, str(r.id))
    want = sequential([r.id for r in sorted(rows, key=key)], [tuple(r) for r in overlapping(spark, sf).collect()])
    got = {r.id: (r.kept, r.overlaps_with) for r in catalog.QUERIES["op_er_09_overlap_filter"](spark, sf).collect()}
    assert got == {r.id: (r.id not in want, want.get(r.id)) for r in rows} and 100 < len(want) < len(rows)


def test_correspondence_equals_union_find(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/part.parquet"), F.expr("l_partkey = p_partkey")).collect()
    members = {}
    for r in lines:
        said = r.p_name.lower().split(" ")[0] if r.l_linenumber % 5 else None
        members.setdefault(r.l_orderkey, []).append((r.l_linenumber, said, r.l_suppkey if (r.l_orderkey + r.l_suppkey) % 4 else None))
    want = set()
    for p in order_conflict(spark, sf).collect():
        both = [("i", *m) for m in members[p.right_id]] + [("e", *m) for m in members[p.left_id]]
        parent = list(range(len(both)))

        def find(k, parent=parent):
            return k if parent[k] == k else find(parent[k])

        def groups(of, both=both):
            found = {}
            for k, m in enumerate(both):
                if m[of] is not None:
                    found.setdefault(m[of], []).append(k)
            return list(found.values())

        named = [g for g in groups(2) if len({both[k][3] for k in g} - {None}) <= 1]
        placed = groups(3)
        for g in named + placed:
            for k in g:
                parent[find(k)] = find(g[0])
        classes = {}
        for k in range(len(both)):
            classes.setdefault(find(k), []).append(k)
        crosses = lambda g, both=both: {both[k][0] for k in g} == {"i", "e"}
        for g in filter(crosses, classes.values()):
            basis = [n for n, links in (("SOURCE_WORDING", named), ("RESOLVED_GEOENTITY", placed)) if any(crosses(x) and set(x) & set(g) for x in links)]
            at = lambda s, g=g, both=both: ",".join(str(x) for x in sorted(both[k][1] for k in g if both[k][0] == s))
            want.add((p.right_id, p.left_id, at("i"), at("e"), ",".join(basis), any(both[k][3] is not None for k in g)))
    rows = catalog.QUERIES["op_er_04_member_correspondence"](spark, sf).collect()
    got = {(r.incoming, r.existing, r.incoming_positions, r.existing_positions, r.basis, r.grounded) for r in rows}
    assert got - want == set() and want - got == set()
    assert {r.basis for r in rows} == {"SOURCE_WORDING", "RESOLVED_GEOENTITY", "SOURCE_WORDING,RESOLVED_GEOENTITY"}
