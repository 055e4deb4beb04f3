"""Rings from ways that share end points."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

RINGS = ArrayType(ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType())))


def close_rings(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings of three points and more. From the first unused way on, the first way that touches either end is
    added, the far end before the near one; what doesn't close is dropped. End points are told by seven decimals."""
    spot = lambda p: (round(p[0], 7), round(p[1], 7))
    ways = [w for w in ways if len(w) >= 2]
    touching = defaultdict(set)
    for i, w in enumerate(ways):
        touching[spot(w[0])].add(i)
        touching[spot(w[-1])].add(i)
    unused, out = set(range(len(ways))), []

    def take(i: int) -> list[tuple[float, float]]:
        unused.discard(i)
        for p in (ways[i][0], ways[i][-1]):
            touching[spot(p)].discard(i)
        return ways[i]

    for first in range(len(ways)):
        if first not in unused:
            continue
        ring = deque(take(first))
        while not (closed := len(ring) > 2 and spot(ring[0]) == spot(ring[-1])):
            far, near = spot(ring[-1]), spot(ring[0])
            found = touching[far] | touching[near]
            if not found:
                break
            way = take(min(found))
            if far in (spot(way[0]), spot(way[-1])):
                ring.extend(way[1:] if spot(way[0]) == far else way[-2::-1])
            else:
                ring.extendleft(way[-2::-1] if spot(way[-1]) == near else way[1:])
        if closed:
            out.append(list(ring))
    return out


@F.arrow_udf(RINGS)
def stitch(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The ways of one element to closed rings; null gives none."""
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    for s in parts:
        ways = ([[(p["x"], p["y"]) for p in line] for line in w or ()] for w in s.to_pylist())
        yield pa.array([[[{"x": x, "y": y} for x, y in r] for r in close_rings(w)] for w in ways], kind)
