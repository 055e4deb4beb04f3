"""Orders and anchors by relevance against sorted pools; atoms against a plain cut."""

import random
import re

from wayloom.operators.text import LONGEST, atoms
from wayloom.plans import catalog, intake
from wayloom.plans.ranking import relevant


def test_relevance_orders_and_anchors(spark, sf):
    pools = {}
    for r in relevant(spark, sf).collect():
        pools.setdefault(r.request_id, []).append(r)
    want = {q: sorted(rows, key=lambda r: (-r.relevance, str(r.experience_id))) for q, rows in pools.items()}
    ranks = {(r.request_id, r.rank): r.experience_id for r in catalog.QUERIES["op_win_04_planner_relevance"](spark, sf).collect()}
    assert ranks == {(q, n): r.experience_id for q, rows in want.items() for n, r in enumerate(rows, 1)}
    days = {(r.request_id, r.day): r.experience_id for r in catalog.QUERIES["op_top_05_day_anchors"](spark, sf).collect()}
    assert days == {(q, n): r.experience_id for q, rows in want.items() for n, r in enumerate(rows[: rows[0].days], 1)}


def plain_atoms(text):
    """Lines, their sentences, their pieces, cut one after the other from the left."""
    out, at = [], 0
    for line in text.split("\n"):
        kind = "heading" if re.match(r"#{1,6}\s", line) else "item" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else "line"
        sentences, rest, base = [], line, at
        while kind == "line":
            found = next((m for m in re.finditer(r"(?<=[.!?])\s+", rest) if len(re.search(r"(\w*)[.!?]$", rest[: m.start()])[1]) > 3), None)
            if not found:
                break
            sentences.append((base, rest[: found.start()]))
            base, rest = base + found.end(), rest[found.end() :]
        sentences.append((base, rest))
        for a, said in sentences:
            while len(said) > LONGEST:
                cut = said.rfind(" ", 1, LONGEST)
                cut = LONGEST if cut <= 0 else cut
                out.append((a, said[:cut], kind))
                a, said = a + cut, said[cut:]
            out.append((a, said, kind))
        at += len(line) + 1
    return [(a + len(s) - len(s.lstrip()), a + len(s.rstrip()), kind) for a, s, kind in out if s.strip()]


def test_atoms_equal_a_plain_cut():
    rng = random.Random(8)
    words = ["Hello", "St.", "world.", "Really?", "e.g.", "x" * 200, "end!", "- item", "# Head", "12) twelve", "\n", "\n\n", "  ", "1.5", "é."]
    for _ in range(3000):
        text = rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(40)))
        got = atoms(text)
        assert got == plain_atoms(text), text
        covered = {i for a, b, _ in got for i in range(a, b)}
        assert {i for i, ch in enumerate(text) if not ch.isspace()} <= covered and sum(b - a for a, b, _ in got) == len(covered)


def test_page_import_equals_sql_beyond_a_million_parts(spark, tmp_path):
    """Part 1,500,003 of page 1 outranks part 7 of page 2 in the SQL's packing, and keeps six digits."""
    import duckdb

    spark.sql("select 1L o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 1_500_003, 5, 1), (1, 7, 5, 2), (1, 2_000_009, 6, 1), (1, 12, 6, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = intake.page_import(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.SQL["op_src_07_page_import"]).fetchall()) == [(1, 5, 2, 500_003), (1, 6, 2, 9)]
