"""Windows of texts: units against the tree walked recursively, coverage and budgets, the first window by plain scores."""

import math
import random
import re

from wayloom.operators.windowing import HEADING, SEPARATOR, chunks, terms, units, windows
from wayloom.plans import catalog
from wayloom.plans.literals import headed


def tree_units(text, most):
    """Units by walking the tree from its root: a node that fits is one, else its own text and then its children."""
    heads = [dict(start=m.start(), level=len(m[1]), children=[]) for m in HEADING.finditer(text)]
    for k, h in enumerate(heads):
        h["end"] = next((g["start"] for g in heads[k + 1 :] if g["level"] <= h["level"]), len(text))
    root = dict(start=0, end=len(text), level=0, children=[])
    for k, h in enumerate(heads):
        parent = next((g for g in reversed(heads[:k]) if g["level"] < h["level"]), root)
        parent["children"].append(h)
    low = [h for h in heads if h["level"] == min(g["level"] for g in heads)]
    out = []

    def walk(node):
        if node is not root and not (len(low) == 1 and node is low[0]) and node["end"] - node["start"] <= most:
            out.append((node["start"], node["end"], True))
            return
        end = node["children"][0]["start"] if node["children"] else node["end"]
        if text[node["start"] : end].strip():
            out.append((node["start"], end, end - node["start"] <= most))
        for child in node["children"]:
            walk(child)

    walk(root)
    return out


def random_text(rng):
    parts = []
    for _ in range(rng.randrange(1, 25)):
        if rng.random() < 0.4:
            parts.append("#" * rng.randint(1, 4) + " " + rng.choice(["Museums", "Parks of the city", "Eat"]))
        parts.append(" ".join(rng.choice(["museum", "park", "city", "river", "a", "food", "x" * 90]) for _ in range(rng.randrange(60))))
        parts.append(rng.choice(["", "", " ", "\n"]))
    return "\n".join(parts)


def test_units_equal_the_tree():
    rng = random.Random(1)
    for _ in range(600):
        text, most = random_text(rng), rng.choice([50, 300, 900, 5000])
        got = [tuple(u) for u in units(text, most)]
        assert got == tree_units(text, most)
        solid = {i for i, c in enumerate(text) if not c.isspace()}
        covered = [i for a, b, _ in got for i in range(a, b)]
        assert len(covered) == len(set(covered)) and solid <= set(covered)


def test_windows_cover_all_and_keep_to_budgets():
    rng, kinds = random.Random(2), set()
    for _ in range(600):
        text, most = random_text(rng), rng.choice([80, 400, 1200])
        unit_most = most * rng.choice([1, 2])
        asked = terms(rng.choice(["Where are the parks?", "museum food", "nothing here"]))
        every, found = windows(text, asked, most, unit_most)
        kinds |= {w[0] for w in found}
        if len(text) <= most:
            assert found == [("WHOLE_DOCUMENT", [0], True)]
            continue
        parts = units(text, unit_most)
        assert every == chunks(text, parts, max(1, most // 4)) and all(c.end - c.start <= max(1, most // 4) for c in every)
        solid = {i for i, c in enumerate(text) if not c.isspace()}
        assert {i for c in every for i in range(c.start, c.end)} >= solid
        assert {k for _, ks, _ in found for k in ks} == set(range(len(every)))
        for strategy, ks, whole in found:
            told = sum(len(text[every[k].start : every[k].end].strip()) for k in ks) + SEPARATOR * (len(ks) - 1)
            touched = {every[k].unit for k in ks}
            full = all(parts[u].whole and {k for k, c in enumerate(every) if c.unit == u} <= set(ks) for u in touched)
            assert whole == full or strategy == "RELEVANCE_WINDOWS" or not whole
            assert told <= most or len(touched) == 1 and whole and told <= unit_most + SEPARATOR * len(ks)
            assert ks == sorted(ks) and (not whole or full)
        # The first window: the unit with most of what is asked for, by how rare it is; ties go to the first.
        bodies = [terms(text[u.start : u.end]) for u in parts]
        paths = []
        for u in parts:
            heads, path, own = [], [], []
            for m in re.finditer(HEADING.pattern, text, re.M):
                path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), m[2])]
                heads.append((m.start(), " ".join(t for _, t in path)))
            own = [t for at, t in heads if at <= u.start][-1:] + [t for at, t in heads if u.start < at < u.end]
            paths.append(terms(" ".join(own)))
        best, top = 0, -1.0
        for k in range(len(parts)):
            score = 0.0
            for t in sorted(asked):
                n = sum(t in b or t in p for b, p in zip(bodies, paths, strict=True))
                score += (2 * (t in paths[k]) or (t in bodies[k])) * math.log(1 + len(parts) / n) if n else 0
            if score > top + 1e-12:
                best, top = k, score
        assert {every[k].unit for k in found[0][1]} <= {best}
    assert kinds == {"WHOLE_DOCUMENT", "SECTION_UNIT", "RELEVANCE_WINDOWS", "DOCUMENT_ORDER_CONTINUATION"}


def test_query_windows_every_document(spark):
    sf = "/root/testdata/sf0.01"
    rows = {}
    for r in catalog.QUERIES["op_txt_08_windows"](spark, sf).collect():
        rows.setdefault(r.doc_id, []).append((r.window, r.strategy, r.n_chunks, r.fresh, r.start, r.end, r.whole))
    docs = {r.doc_id: r for r in headed(spark, sf).collect()}
    assert set(rows) == set(docs)
    for k, r in docs.items():
        every, found = windows(r.text or "", terms(r.asked or ""), 2000, 4000)
        assert [w[0] for w in sorted(rows[k])] == list(range(1, len(found) + 1)) and sum(w[3] for w in rows[k]) == len(every)
    assert len({w[1] for v in rows.values() for w in v}) >= 3
