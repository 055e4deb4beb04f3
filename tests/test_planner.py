"""Day plans against a plain twin, on the customers' wish lists and on random pools that reach every branch."""

import math
import random
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest

from wayloom.operators import planner
from wayloom.plans import catalog
from wayloom.plans.planner import wishes


def far(a, b):
    (la, lo), (lb, ob) = a, b
    la, lo, lb, ob = map(math.radians, (la, lo, lb, ob))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def missing(v):
    return v is None or v != v


class Twin:
    """The rules by recomputing everything from plain dicts, a day as a dict of stops, minutes and metres."""

    def __init__(self, rows):
        self.rows = sorted(rows, key=lambda r: (-r["relevance"], str(r["experience_id"])))
        self.ask = self.rows[0]

    def rank(self, r):
        return (-r["relevance"], str(r["experience_id"]))

    def minutes(self, r):
        return r["duration_minutes"] + (0 if missing(r["inner_minutes"]) else r["inner_minutes"])

    def inside(self, r):
        if not missing(r["inner_walk_m"]):
            return r["inner_walk_m"]
        return 0 if not missing(r["inner_walk_minutes"]) or r["point"] else 1500

    def leg(self, a, b):
        modes = self.ask["modes"]
        if a is None or modes is None or not len(modes):
            return dict(minutes=0, metres=0, foot=0)
        mode = "WALKING" if "WALKING" in modes else modes[0]
        m = 1.3 * far((a["end_latitude"], a["end_longitude"]), (b["start_latitude"], b["start_longitude"]))
        return dict(minutes=m / 1000 / {"WALKING": 4.5, "CYCLING": 13, "DRIVING": 25, "PUBLIC_TRANSPORT": 25}[mode] * 60, metres=m, foot=m if mode == "WALKING" else 0)

    def tired(self, r, leg, before):
        out = []
        if self.ask["modes"] is not None and "WALKING" in self.ask["modes"] and before + self.inside(r) + leg["foot"] > self.ask["walk_per_day"]:
            out.append("MAX_WALKING_PER_DAY_EXCEEDED")
        longest = self.inside(r) if missing(r["inner_longest_m"]) else r["inner_longest_m"]
        if max(leg["foot"], longest) > self.ask["walk_at_once"]:
            out.append("MAX_CONTINUOUS_WALKING_EXCEEDED")
        return out

    def closed(self, r, number, a, b):
        if missing(self.ask["weekday"]) or r["hours"] is None:
            return False
        today = [h for h in r["hours"] if h["weekday"] == (self.ask["weekday"] + number - 1) % 7]
        return bool(today) and not any(x["start"] <= a and b <= x["end"] for x in today[0]["ranges"])

    def against(self, r, day, stops=None, minutes=None):
        stops, minutes = day["stops"] if stops is None else stops, day["minutes"] if minutes is None else minutes
        if any(missing(r[c]) or math.isinf(r[c]) for c in ("latitude", "longitude")):
            return ["INVALID_SPATIAL_FOOTPRINT"]
        leg = self.leg(stops[-1] if stops else None, r)
        out = []
        if stops and (self.ask["modes"] is None or not len(self.ask["modes"])):
            out.append("NO_ALLOWED_TRAVEL_MODE")
        if minutes + self.minutes(r) + leg["minutes"] > self.ask["window_end"] - self.ask["window_start"]:
            out.append("DAILY_TIME_CAPACITY_EXCEEDED")
        out += self.tired(r, leg, day["walked"])
        at = self.ask["window_start"] + minutes
        return out + (["OPENING_HOURS_INCOMPATIBLE"] if self.closed(r, day["n"], at, at + self.minutes(r)) else [])

    def centre(self, day):
        n = len(day["stops"])
        return sum(s["latitude"] for s in day["stops"]) / n, sum(s["longitude"] for s in day["stops"]) / n

    def away(self, r, day):
        return far((r["latitude"], r["longitude"]), self.centre(day)) if day["stops"] else 0

    def shift(self, r, a, b):
        for d, s in ((a, -1), (b, 1)):
            d["minutes"] += s * self.minutes(r)
            d["walked"] += s * self.inside(r)

    def one_step(self, days):
        for a in days:
            for r in a["stops"]:
                for b in days:
                    if not r["must"] and a is not b and len(b["stops"]) + 1 < len(a["stops"]) and not self.against(r, b):
                        a["stops"] = [s for s in a["stops"] if s is not r]
                        b["stops"] = [*b["stops"], r]
                        self.shift(r, a, b)
                        return True
        for a in days:
            for b in days:
                for r in a["stops"] if a["n"] < b["n"] else ():
                    for s in b["stops"]:
                        if r["must"] or s["must"] or self.away(s, a) + self.away(r, b) >= self.away(r, a) + self.away(s, b):
                            continue
                        rest_a, rest_b = [x for x in a["stops"] if x is not r], [x for x in b["stops"] if x is not s]
                        if self.against(s, a, rest_a, a["minutes"] - self.minutes(r)) or self.against(r, b, rest_b, b["minutes"] - self.minutes(s)):
                            continue
                        a["stops"] = [s if x is r else x for x in a["stops"]]
                        b["stops"] = [r if x is s else x for x in b["stops"]]
                        self.shift(r, a, b)
                        self.shift(s, b, a)
                        return True
        return False

    def schedule(self, stops, day):
        rest, out, at, walked = sorted(stops, key=self.rank), [], self.ask["window_start"], 0
        while rest:
            last, able, why = out[-1][0] if out else None, [], set()
            for r in rest:
                leg = self.leg(last, r)
                a = at + leg["minutes"]
                b = a + self.minutes(r)
                no = ["DAILY_TIME_CAPACITY_EXCEEDED"] if b > self.ask["window_end"] else ["OPENING_HOURS_INCOMPATIBLE"] if self.closed(r, day["n"], a, b) else self.tired(r, leg, walked)
                why |= set(no)
                if not no:
                    able.append((r, a, b, leg))
            if not able:
                for reason in ("MAX_CONTINUOUS_WALKING_EXCEEDED", "MAX_WALKING_PER_DAY_EXCEEDED", "OPENING_HOURS_INCOMPATIBLE"):
                    if reason in why:
                        return reason
                return "DAILY_TIME_CAPACITY_EXCEEDED"
            if last is not None:
                able.sort(key=lambda x: (far((last["end_latitude"], last["end_longitude"]), (x[0]["start_latitude"], x[0]["start_longitude"])), x[1], str(x[0]["experience_id"])))
            r, _, at, leg = able[0]
            walked += self.inside(r) + leg["foot"]
            rest = [x for x in rest if x is not r]
            out.append(able[0])
        return out

    def solve(self):
        days = [dict(n=d + 1, stops=[], minutes=0, walked=0) for d in range(max(0, self.ask["days"]))]
        verdict, taken = {}, set()
        for r in [r for r in self.rows if r["must"]] + [r for r in self.rows if not r["must"]]:
            if r["experience_id"] in taken:
                verdict[id(r)] = ["DUPLICATE_EXPERIENCE"]
                continue
            no = {d["n"]: self.against(r, d) for d in days}
            able = [d for d in days if not no[d["n"]]]
            if not able:
                verdict[id(r)] = list(dict.fromkeys(x for d in days for x in no[d["n"]])) or ["NO_FEASIBLE_DAY"]
                continue
            d = max(able, key=lambda d: (r["relevance"] + 0.25 * (1 / (len(d["stops"]) + 1)), -d["n"]))
            leg = self.leg(d["stops"][-1] if d["stops"] else None, r)
            d["minutes"] += self.minutes(r) + leg["minutes"]
            d["walked"] += self.inside(r) + leg["foot"]
            d["stops"].append(r)
            taken.add(r["experience_id"])
        placed = {id(r): d["n"] for d in days for r in d["stops"]}
        steps = 1
        while steps < 50 and self.one_step(days):
            steps += 1
        if steps == 50:
            self.one_step(days)
        improved = {id(r): d["n"] for d in days for r in d["stops"]}
        timed, gone = {}, {}
        for d in days:
            kept = sorted(d["stops"], key=self.rank)
            while kept:
                found = self.schedule(kept, d)
                if not isinstance(found, str):
                    timed |= {id(r): (d["n"], n, round(a, 4), round(b, 4), round(leg["minutes"], 4), round(leg["metres"], 3)) for n, (r, a, b, leg) in enumerate(found, 1)}
                    break
                free = [r for r in kept if not r["must"]]
                out = (free or kept)[-1]
                gone[id(out)] = found
                kept = [r for r in kept if r is not out]
        return sorted(
            ((r["experience_id"], placed.get(id(r)), verdict.get(id(r)), improved.get(id(r)), timed.get(id(r)), gone.get(id(r)), steps) for r in self.rows), key=str)


def told(frame):
    none = lambda v: None if v is pd.NA or missing(v) else v
    out = []
    for r in frame.itertuples(index=False):
        at = None if none(r.day) is None else (int(r.day), int(r.position), round(r.start_minute, 4), round(r.end_minute, 4), round(r.travel_minutes, 4), round(r.travel_m, 3))
        number = lambda v: None if none(v) is None else int(v)
        out.append((r.experience_id, number(r.placed_day), None if r.placed_reasons is None else list(r.placed_reasons), number(r.improved_day), at, none(r.repair_reason), r.steps))
    return sorted(out, key=str)


def random_pool(rng, n):
    """Stops around one city, with unknown facts, repeated rows and places that aren't numbers."""
    ask = dict(
        request_id=1, days=rng.randint(0, 4), window_start=540.0, window_end=rng.choice([900.0, 1200.0]), modes=rng.choice([["WALKING"], ["CYCLING", "DRIVING"], ["DRIVING", "WALKING"], [], None]),
        walk_per_day=rng.choice([3e3, 12e3, 4e4]), walk_at_once=rng.choice([800.0, 3e3, 2e4]), weekday=rng.choice([None, 0, 3, 6]))
    rows = []
    for k in range(n):
        lat, lon = rng.uniform(-34.65, -34.55), rng.uniform(-58.45, -58.35)
        maybe = lambda v: v if rng.random() < 0.5 else None
        hours = maybe([dict(weekday=d, ranges=[dict(start=s, end=s + rng.choice([180, 400, 660])) for s in rng.sample([480, 540, 700, 900], rng.randint(0, 2))]) for d in range(7) if rng.random() < 0.8])
        rows.append(ask | dict(
            experience_id=k if rng.random() < 0.95 else max(0, k - 1), relevance=rng.choice([0.5, round(rng.random(), 3)]), must=rng.random() < 0.15, duration_minutes=rng.randint(30, 180),
            latitude=rng.choice([lat] * 20 + [math.nan, None, math.inf]), longitude=lon, start_latitude=lat, start_longitude=lon, end_latitude=lat + rng.choice([0, 0.01]), end_longitude=lon,
            point=rng.random() < 0.5, hours=hours, inner_minutes=maybe(float(rng.randint(0, 60))), inner_walk_m=maybe(float(rng.randint(0, 2000))), inner_walk_minutes=maybe(5.0), inner_longest_m=maybe(float(rng.randint(0, 1500)))))
    return rows


def test_plans_equal_the_twin_on_random_pools():
    rng, seen = random.Random(11), set()
    moved = swapped = 0
    for _ in range(1000):
        rows = random_pool(rng, rng.randint(1, 30))
        want = Twin(rows).solve()
        got = told(planner.plan(pd.DataFrame(rows).astype({"weekday": object, "latitude": object})))
        assert got == want
        seen |= {x for w in want for x in (w[2] or [])} | {f"repair {w[5]}" for w in want if w[5]}
        moved += any(w[1] != w[3] for w in want)
        swapped += any(w[6] > 2 for w in want)
    assert seen >= {planner.INVALID, planner.NO_MODE, planner.FULL, planner.DAY_WALK, planner.LONG_WALK, planner.CLOSED, planner.DUPLICATE, planner.NO_DAY}
    assert seen >= {f"repair {r}" for r in (planner.FULL, planner.DAY_WALK, planner.LONG_WALK, planner.CLOSED)} and moved > 10 and swapped > 10


@pytest.fixture(scope="module")
def solved(spark, sf):
    rows = {}
    for r in wishes(spark, sf).collect():
        rows.setdefault(r.request_id, []).append(r.asDict(recursive=True))
    return {k: Twin(v).solve() for k, v in rows.items()}


def test_wish_lists_equal_the_twin(spark, sf, solved):
    frame = planner.plan_days(wishes(spark, sf)).toPandas()
    assert {k: told(g) for k, g in frame.groupby("request_id")} == solved
    assert sum(w[5] is not None for v in solved.values() for w in v) > 20 and sum(w[1] != w[3] for v in solved.values() for w in v) > 20


def test_queries_tell_the_plan(spark, sf, solved):
    flat = [(k, *w) for k, v in solved.items() for w in v]
    run = lambda name: catalog.QUERIES[name](spark, sf).collect()
    got = {(r.request_id, r.experience_id): (r.day, r.reasons) for r in run("op_plan_04_hard_constraints")}
    assert got == {(k, e): (d, None if why is None else ",".join(why)) for k, e, d, why, *_ in flat}
    assert {(r.request_id, r.experience_id, r.placed_day, r.day, r.steps) for r in run("op_plan_06_local_improvement")} == {(k, e, d, i, n) for k, e, d, _, i, _, _, n in flat if d}
    assert {(r.request_id, r.experience_id, r.day, r.position) for r in run("op_plan_07_routed_order")} == {(k, e, t[0], t[1]) for k, e, _, _, _, t, _, _ in flat if t}
    assert {(r.request_id, r.experience_id, r.reason) for r in run("op_plan_08_repair")} == {(k, e, g) for k, e, _, _, _, _, g, _ in flat if g}
    got = {r.request_id: (r.score, r.refused, r.dropped, r.steps, r.legs) for r in run("op_plan_09_solution")}
    assert got == {k: (sum(w[4] is not None for w in v), sum(w[1] is None for w in v), sum(w[5] is not None for w in v), v[0][6], sum(w[4] is not None and w[4][1] > 1 for w in v)) for k, v in solved.items()}


def test_requests_of_a_batch_are_planned_together():
    """Those of one table equal each planned alone; a request of many stops needs no distance of all pairs."""
    rng = random.Random(12)
    pools = [[r | {"request_id": k} for r in random_pool(rng, rng.choice([1, 3, 30]))] for k in range(60)]
    pools.append([r | {"request_id": 60, "experience_id": i} for i, r in enumerate(random_pool(rng, 20) * 200)])
    frames = [pd.DataFrame(p).astype({"weekday": object, "latitude": object}) for p in pools]
    kinds = pa.schema([(c, planner._POOL.get(c, pa.float64())) for c in frames[0].columns])
    table = pa.concat_tables([pa.Table.from_pandas(f, kinds, preserve_index=False) for f in frames])
    at = [0]
    for p in pools:
        at.append(at[-1] + len(p))
    tracemalloc.start()
    got = planner._plans(table, at).to_pandas()
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert {k: told(g) for k, g in got.groupby("request_id")} == {k: told(planner.plan(f)) for k, f in enumerate(frames)}


def test_empty_pool(spark, sf):
    assert planner.plan_days(wishes(spark, sf).limit(0)).count() == 0
