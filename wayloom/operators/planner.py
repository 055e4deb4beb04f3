"""Day plans under hard constraints: placement, bounded local search, routed order with repair.

One request is one group: what a traveller asks to be planned (a wish list, bounded by the request, not by the catalog).
Placement goes over all requests of a batch at once, a stop of each per step, as arrays of requests and days. What follows
only looks at the stops placed, a few per day: they are numbers into flat lists; of each day the search holds the stops, the
minutes and metres charged so far and, for swaps, the distance of every placed stop to the day's centre, which only changes
where a day does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..functions.policy import DETOUR, FALLBACK_MINUTES, SPEEDS
from .runs import by_key, numbers

# Reasons of refusal, the weight of an empty day, steps of the local search.
INVALID, NO_MODE, FULL = "INVALID_SPATIAL_FOOTPRINT", "NO_ALLOWED_TRAVEL_MODE", "DAILY_TIME_CAPACITY_EXCEEDED"
DAY_WALK, LONG_WALK, CLOSED = "MAX_WALKING_PER_DAY_EXCEEDED", "MAX_CONTINUOUS_WALKING_EXCEEDED", "OPENING_HOURS_INCOMPATIBLE"
DUPLICATE, NO_DAY = "DUPLICATE_EXPERIENCE", "NO_FEASIBLE_DAY"
#: Of the reasons why no stop can follow, the one that is told.
TOLD = (LONG_WALK, DAY_WALK, CLOSED)
BALANCE, MOST_STEPS = 0.25, 50

PLAN_SCHEMA = (
    "request_id long, experience_id long, placed_day int, placed_reasons array<string>, improved_day int, day int, position int, "
    "start_minute double, end_minute double, travel_minutes double, travel_m double, walking_m double, repair_reason string, steps int"
)


def metres(lat1, lon1, lat2, lon2):
    """Great-circle distance, of numbers or of arrays."""
    a, b = np.radians(lat1), np.radians(lat2)
    with np.errstate(invalid="ignore"):
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
        return 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


@dataclass
class Day:
    number: int
    weekday: int | None
    stops: list[int] = field(default_factory=list)
    minutes: float = 0.0
    walked: float = 0.0


class Stops:
    """The stops of whole requests as arrays, those of a request in order of relevance, ties by id as text; ``at`` is where
    each request begins. What is asked for is that of a request's first stop."""

    def __init__(self, table: pa.Table, at: list[int]):
        sizes = np.diff(at)
        ids = table.column("experience_id").to_pylist()
        relevance = numbers(table.column("relevance"))
        key = (-relevance).tolist()
        order = np.array([i for a, b in zip(at, at[1:], strict=False) for i in sorted(range(a, b), key=lambda i: (key[i], str(ids[i])))], np.int64)
        number = lambda c: numbers(table.column(c))[order]
        flag = lambda c: table.column(c).fill_null(False).to_numpy()[order]
        self.at, self.sizes, self.of = np.array(at[:-1], np.int64), sizes, np.repeat(np.arange(len(sizes)), sizes)
        self.request_id, self.ids = table.column("request_id").take(pa.array(order)), table.column("experience_id").take(pa.array(order))
        first = order[self.at]
        ask = lambda c: numbers(table.column(c))[first]
        self.begin, self.end, self.per_day, self.at_once, self.weekday = map(ask, ("window_start", "window_end", "walk_per_day", "walk_at_once", "weekday"))
        self.n_days = np.maximum(0, ask("days").astype(np.int64))
        modes = [m or [] for m in table.column("modes").take(pa.array(first)).to_pylist()]
        self.mode = [None if not m else "WALKING" if "WALKING" in m else m[0] for m in modes]
        self.relevance, self.must = relevance[order], flag("must")
        self.lat, self.lon = number("latitude"), number("longitude")
        self.ends = [number(c) for c in ("end_latitude", "end_longitude")]
        self.starts = [number(c) for c in ("start_latitude", "start_longitude")]
        inner, walk, minutes, longest = map(number, ("inner_minutes", "inner_walk_m", "inner_walk_minutes", "inner_longest_m"))
        self.occupied = number("duration_minutes") + np.where(np.isnan(inner), 0.0, inner)
        unknown = FALLBACK_MINUTES * SPEEDS["WALKING"] * 1000 / 60
        self.walk = np.where(~np.isnan(walk), walk, np.where(~np.isnan(minutes) | flag("point"), 0.0, unknown))
        self.longest = np.where(np.isnan(longest), self.walk, longest)
        _, self.same = np.unique(np.stack([self.of, np.unique(np.array(ids)[order], return_inverse=True)[1]]), axis=1, return_inverse=True)
        self._hours(table.column("hours").combine_chunks(), order)

    def _hours(self, hours: pa.ListArray, order: np.ndarray) -> None:
        """``entry``: by stop and weekday, the number of its list of ranges, -1 where unknown; ``opens`` and ``closes``: by
        list, its ranges, filled up with such that hold nothing."""
        hours = hours if isinstance(hours, pa.ListArray) else hours.chunk(0)
        days = hours.flatten()
        row = np.repeat(np.arange(len(hours)), hours.value_lengths().fill_null(0).to_numpy())
        weekday = numbers(pa.chunked_array([days.field("weekday")]))
        n = days.field("ranges").value_lengths().fill_null(0).to_numpy()
        spans = days.field("ranges").flatten()
        entry = np.full((len(hours), 7), -1, np.int64)
        known = np.isin(weekday, range(7))
        entry[row[known], weekday[known].astype(np.int64)] = np.flatnonzero(known)
        self.entry = entry[order]
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        shape = (len(n) + 1, max(1, int(n.max(initial=0))))
        self.opens, self.closes = np.full(shape, np.inf), np.full(shape, -np.inf)
        self.opens[of, nth] = numbers(pa.chunked_array([spans.field("start")]))
        self.closes[of, nth] = numbers(pa.chunked_array([spans.field("end")]))

    def open(self, k: np.ndarray, weekday: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unknown hours, days and dates count as open; weekday is NaN for no date."""
        at = np.where(np.isnan(weekday), -1, self.entry[k, np.nan_to_num(weekday).astype(np.int64)])
        return (at < 0) | ((start[..., None] >= self.opens[at]) & (end[..., None] <= self.closes[at])).any(axis=-1)

    def straight(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Metres from where stops end to where others begin."""
        return metres(self.ends[0][a], self.ends[1][a], self.starts[0][b], self.starts[1][b])

    def leg(self, straight: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(minutes, metres, metres on foot) of requests' legs; without any mode they can't be told, so nothing."""
        speed = np.array([SPEEDS.get(m, SPEEDS["WALKING"]) for m in self.mode])[r]
        m = np.where(np.array([m is None for m in self.mode])[r], 0.0, straight * DETOUR)
        return m / 1000 / speed * 60, m, np.where(np.array([m == "WALKING" for m in self.mode])[r], m, 0.0)

    def place(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """Musts first; each stop goes to the feasible day of greatest relevance + balance, the first of equals. By stop its
        day from 0, -1 for none, and the number of its reasons; by request and day minutes and metres; the reasons."""
        turns = np.lexsort((np.arange(len(self.of)), ~self.must, self.of))
        shape = (len(self.sizes), max(1, int(self.n_days.max(initial=0))))
        d = np.arange(shape[1])
        exists, weekday = d < self.n_days[:, None], (self.weekday[:, None] + d) % 7
        last, count = np.full(shape, -1, np.int64), np.zeros(shape, np.int64)
        minutes, walked = np.zeros(shape), np.zeros(shape)
        day, why = np.full(len(self.of), -1, np.int64), np.full(len(self.of), -1, np.int64)
        taken = np.zeros(len(self.of) + 1, bool)
        placeless = ~(np.isfinite(self.lat) & np.isfinite(self.lon))
        walks, modeless = np.array([m == "WALKING" for m in self.mode]), np.array([m is None for m in self.mode])
        room = self.end - self.begin
        kinds: dict[tuple, int] = {}
        by_size = np.argsort(-self.sizes, kind="stable")
        left = np.searchsorted(-self.sizes[by_size], -np.arange(self.sizes.max(initial=0)))  # requests of more stops than so many
        for turn, n in enumerate(left.tolist()):
            r = by_size[:n]
            k = turns[self.at[r] + turn]
            duplicate, kk, rr = taken[self.same[k]], k[:, None], r[:, None]
            before = last[r] >= 0
            travel, _, on_foot = self.leg(np.where(before, self.straight(last[r], kk), 0.0), rr)
            start, busy = self.begin[rr] + minutes[r], self.occupied[kk]
            no = (before & modeless[rr]) * 1
            no |= (minutes[r] + busy + travel > room[rr]) * 2
            no |= (walks[rr] & (walked[r] + self.walk[kk] + on_foot > self.per_day[rr])) * 4
            no |= ((on_foot > self.at_once[rr]) | (self.longest[kk] > self.at_once[rr])) * 8
            no |= ~self.open(kk, weekday[r], start, start + busy) * 16
            no = np.where(placeless[kk], 32, no)
            score = np.where(exists[r] & (no == 0), self.relevance[kk] + BALANCE * (1 / (count[r] + 1)), -np.inf)
            score[np.isnan(score)] = -np.inf
            best = score.argmax(axis=1)
            some = (score[np.arange(n), best] > -np.inf) & ~duplicate
            refused = np.where(exists[r], no, 0)
            for i in np.flatnonzero(~some).tolist():
                said = (64,) if duplicate[i] else tuple(refused[i].tolist())
                why[k[i]] = kinds.setdefault(said, len(kinds))
            k, r, b = k[some], r[some], best[some]
            minutes[r, b] += self.occupied[k] + travel[some, b]
            walked[r, b] += self.walk[k] + on_foot[some, b]
            last[r, b], day[k] = k, b
            count[r, b] += 1
            taken[self.same[k]] = True
        return day, why, minutes, walked, [_reasons(said) for said in kinds]


@lru_cache(maxsize=1 << 16)
def _reasons(said: tuple[int, ...]) -> list[str]:
    """The reasons of days' bits, each once, in the order met."""
    names = (NO_MODE, FULL, DAY_WALK, LONG_WALK, CLOSED, INVALID, DUPLICATE)
    return list(dict.fromkeys(name for no in said for bit, name in enumerate(names) if no >> bit & 1)) or [NO_DAY]


class Planner:
    """The placed stops of one request, a to b of ``keep`` in order of relevance, and its limits. gap, travel, m and on_foot
    are of each two of them, row by row."""

    def __init__(self, s: Stops, r: int, keep: np.ndarray, gap: list, travel: list, m: list, on_foot: list):
        column = lambda v: v[keep].tolist()
        self.n, self.gap, self.legs = len(keep), gap, list(zip(travel, m, on_foot, strict=True))
        self.ids, self.must, self.occupied, self.walk, self.longest, self.entry = s.ids.take(pa.array(keep)).to_pylist(), *map(column, (s.must, s.occupied, s.walk, s.longest, s.entry))
        self.lat, self.lon, self.opens, self.closes = s.lat[keep], s.lon[keep], s.opens, s.closes
        self.begin, self.end, self.per_day, self.at_once = (float(v[r]) for v in (s.begin, s.end, s.per_day, s.at_once))
        self.mode = s.mode[r]
        self.ranges: dict[int, list[tuple]] = {}

    def leg(self, a: int | None, b: int) -> tuple[float, float, float]:
        """(minutes, metres, metres on foot) to b, none from no stop."""
        return (0.0, 0.0, 0.0) if a is None else self.legs[a * self.n + b]

    def walking(self, k: int, on_foot: float, before: float) -> list[str]:
        day = self.mode == "WALKING" and before + self.walk[k] + on_foot > self.per_day
        return [DAY_WALK] * day + [LONG_WALK] * (on_foot > self.at_once or self.longest[k] > self.at_once)

    def open(self, k: int, weekday: int | None, start: float, end: float) -> bool:
        if weekday is None or (at := self.entry[k][weekday]) < 0:
            return True
        if (ranges := self.ranges.get(at)) is None:
            ranges = self.ranges[at] = list(zip(self.opens[at].tolist(), self.closes[at].tolist(), strict=True))
        return any(start >= a and end <= b for a, b in ranges)

    def fits(self, k: int, day: Day, last: int | None, minutes: float) -> bool:
        """Can k follow ``last`` on a day of so many minutes?"""
        if last is not None and self.mode is None:
            return False
        travel, _, on_foot = self.leg(last, k)
        if minutes + self.occupied[k] + travel > self.end - self.begin or self.walking(k, on_foot, day.walked):
            return False
        start = self.begin + minutes
        return self.open(k, day.weekday, start, start + self.occupied[k])

    def pass_on(self, k: int, source: Day, target: Day) -> None:
        """What is the stop's own changes days with it; legs stay charged where they were."""
        for day, sign in ((source, -1), (target, 1)):
            day.minutes += sign * self.occupied[k]
            day.walked += sign * self.walk[k]

    def move(self, days: list[Day]) -> bool:
        for source in days:
            for k in source.stops:
                for target in () if self.must[k] else days:
                    if target is source or len(target.stops) + 1 >= len(source.stops):
                        continue
                    if self.fits(k, target, target.stops[-1] if target.stops else None, target.minutes):
                        source.stops.remove(k)
                        target.stops.append(k)
                        self.pass_on(k, source, target)
                        return True
        return False

    def to_centre(self, day: Day) -> list[float]:
        """Metres of every placed stop to the mean of the day's."""
        n = len(day.stops)
        return metres(self.lat, self.lon, sum(self.lat[day.stops]) / n, sum(self.lon[day.stops]) / n).tolist()

    def swap(self, days: list[Day], far: dict[int, list[float]]) -> bool:
        for x, a in enumerate(days):
            for b in days[x + 1 :]:
                if not a.stops or not b.stops:
                    continue
                for day in (a, b):
                    if day.number not in far:
                        far[day.number] = self.to_centre(day)
                da, db = far[a.number], far[b.number]
                for i in a.stops:
                    for j in b.stops:
                        if self.must[i] or self.must[j] or da[j] + db[i] >= da[i] + db[j]:
                            continue
                        if self.replaceable(a, i, j) and self.replaceable(b, j, i):
                            a.stops[a.stops.index(i)], b.stops[b.stops.index(j)] = j, i
                            self.pass_on(i, a, b)
                            self.pass_on(j, b, a)
                            return True
        return False

    def replaceable(self, day: Day, old: int, new: int) -> bool:
        """May ``new`` end the day once ``old`` is gone?"""
        rest = [k for k in day.stops if k != old]
        return self.fits(new, day, rest[-1] if rest else None, day.minutes - self.occupied[old])

    def improve(self, days: list[Day]) -> int:
        """Moves to much emptier days, else swaps that bring both days together, until there is none; the steps tried."""
        far: dict[int, list[float]] = {}
        for step in range(1, MOST_STEPS + 1):
            before = [list(d.stops) for d in days]
            if not (self.move(days) or self.swap(days, far)):
                return step
            for day, stops in zip(days, before, strict=True):
                if day.stops != stops:
                    far.pop(day.number, None)
        return MOST_STEPS

    def follow(self, last: int | None, rest: list[int], day: Day, clock: float, walked: float) -> tuple | str:
        """The nearest stop that can come next with its times, the most relevant one if it is the first; else the reason."""
        fits, why = [], set()
        for k in rest:
            travel, m, on_foot = self.leg(last, k)
            start = clock + travel
            end = start + self.occupied[k]
            if end > self.end:
                why.add(FULL)
            elif not self.open(k, day.weekday, start, end):
                why.add(CLOSED)
            elif no := self.walking(k, on_foot, walked):
                why.update(no)
            else:
                fits.append((0.0 if last is None else self.gap[last * self.n + k], start, str(self.ids[k]), k, end, travel, m, on_foot))
        if not fits:
            return next((r for r in TOLD if r in why), FULL)
        return fits[0] if last is None else min(fits, key=lambda f: f[:3])

    def route(self, stops: list[int], day: Day) -> list[tuple] | str:
        rest, last, clock, walked, out = list(stops), None, self.begin, 0.0, []
        while rest:
            found = self.follow(last, rest, day, clock, walked)
            if isinstance(found, str):
                return found
            _, start, _, last, clock, travel, m, on_foot = found
            walked += self.walk[last] + on_foot
            rest.remove(last)
            out.append((last, start, clock, travel, m, self.walk[last] + on_foot))
        return out

    def order(self, day: Day) -> tuple[list[tuple], dict[int, str]]:
        """The day routed anew; while that fails, its least relevant stop goes with the reason, musts only if none else is."""
        kept, dropped = sorted(day.stops), {}
        while kept:
            found = self.route(kept, day)
            if not isinstance(found, str):
                return found, dropped
            gone = next((k for k in reversed(kept) if not self.must[k]), kept[-1])
            kept.remove(gone)
            dropped[gone] = found
        return [], dropped


NAMES = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]
_TEXTS = pa.list_(pa.string())
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": _TEXTS}
_PLAN = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in PLAN_SCHEMA.split(", ")])
_HOURS = pa.list_(pa.struct([("weekday", pa.int32()), ("ranges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
_POOL = {"request_id": pa.int64(), "experience_id": pa.int64(), "must": pa.bool_(), "point": pa.bool_(), "modes": _TEXTS, "hours": _HOURS}


def _plans(table: pa.Table, at: list[int]) -> pa.RecordBatch:
    """One row per stop of whole requests, with what became of it at each step; see PLAN_SCHEMA."""
    s = Stops(table, at)
    day, why, minutes, walked, kinds = s.place()
    kept = np.flatnonzero(day >= 0)
    n = np.bincount(s.of[kept], minlength=len(s.sizes))
    begins, pairs = np.cumsum(n) - n, np.cumsum(n * n) - n * n
    other = np.arange((n * n).sum()) - np.repeat(np.cumsum(n[s.of[kept]]) - n[s.of[kept]], n[s.of[kept]]) + np.repeat(begins[s.of[kept]], n[s.of[kept]])
    a, b = np.repeat(kept, n[s.of[kept]]), kept[other]
    gap = s.straight(a, b)
    held = [v.tolist() for v in (gap, *s.leg(gap, s.of[a]))]
    improved, dropped = np.full(len(day), -1, np.int64), [None] * len(day)
    position, steps = np.zeros(len(day), np.int64), np.ones(len(s.sizes), np.int64)
    times = np.zeros((5, len(day)))
    days_of, weekdays, minutes, walked = day[kept].tolist(), s.weekday.tolist(), minutes.tolist(), walked.tolist()
    for r in np.flatnonzero(n).tolist():
        first, size, pair = int(begins[r]), int(n[r]), int(pairs[r])
        keep = kept[first : first + size]
        p = Planner(s, r, keep, *(v[pair : pair + size * size] for v in held))
        weekday = None if weekdays[r] != weekdays[r] else int(weekdays[r])
        days = [Day(d + 1, None if weekday is None else (weekday + d) % 7, [], minutes[r][d], walked[r][d]) for d in range(int(s.n_days[r]))]
        for k in sorted(range(size), key=lambda k: not p.must[k]):
            days[days_of[first + k]].stops.append(k)
        steps[r] = p.improve(days)
        for d in days:
            improved[keep[d.stops]] = d.number
            found, gone = p.order(d)
            for k, reason in gone.items():
                dropped[keep[k]] = reason
            if found:
                went = keep[[f[0] for f in found]]
                position[went] = range(1, len(found) + 1)
                times[:, went] = np.array([f[1:] for f in found]).T
    whole = lambda v, none: pa.array(v, pa.int32(), mask=none)
    idle = position == 0
    reasons = pa.array(kinds, _TEXTS).take(pa.array(why, mask=why < 0))
    timed = [pa.array(t, pa.float64(), mask=idle) for t in times]
    columns = [s.request_id, s.ids, whole(day + 1, day < 0), reasons, whole(improved, improved < 0), whole(improved, idle), whole(position, idle), *timed, pa.array(dropped, pa.string()), whole(steps[s.of], None)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_PLAN)


def plan(pool: pd.DataFrame) -> pd.DataFrame:
    """The plan of a frame of one request."""
    frame = pd.DataFrame(columns=NAMES)
    if len(pool):
        schema = pa.schema([(c, _POOL.get(c, pa.float64())) for c in pool.columns])
        rows = _plans(pa.Table.from_pandas(pool, schema, preserve_index=False), [0, len(pool)]).to_pylist()
        frame = pd.DataFrame([tuple(r.values()) for r in rows], columns=NAMES).astype({c: "Int32" for c in ("placed_day", "improved_day", "day", "position")})
    return frame


def plan_days(pool: DataFrame, dealt: bool = False) -> DataFrame:
    """Plans of all requests. pool has a row per request and stop: request_id, days, window_start, window_end, modes,
    walk_per_day, walk_at_once, weekday of the first day (null: no date), experience_id, relevance, must, duration_minutes,
    latitude, longitude, start_ and end_ of both, point, hours (weekday, ranges; null: unknown) and, null where unknown,
    inner_minutes, inner_walk_m, inner_walk_minutes, inner_longest_m. A stop that repeats is refused as a duplicate, one
    without a finite place as invalid; the request's columns are those of its most relevant stop.

    Requests are many and short, so a task plans those of an Arrow batch together. A pool that is dealt and sorted by
    request_id already, which costs less before it has all its columns, is told by ``dealt``."""
    return by_key(pool, "request_id", _plans, PLAN_SCHEMA, dealt)
