"""Points in many areas: covers of cells, coarse inside and fine along the boundary, joined by equality.

An area is covered by cells of a quadtree over degrees. Cells that no edge enters lie inside or outside as a whole; a
point in an inner one needs no test. Cells on the boundary are split while they are large beside the area or hold many
edges, and keep the edges that a ray to the east can meet from within them, so the test of a point costs those few. A
point has one cell per level in use, so both sides meet by equality and neither is collected; a hot cell is a skewed key
that Spark's adaptive join splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import contains
from .blocks import COPIES

#: Levels of cells: 360 / 2 ** level degrees wide and high.
LEVELS = tuple(range(4, 21, 2))
#: Cells of the finest level are at least this part of the area; boundary cells are split while they hold more edges.
FINEST, COARSEST, MANY_EDGES = 256, 4, 12
COVER = "area_id long, _level int, _x long, _y long, edges array<array<struct<ax:double,ay:double,bx:double,by:double>>>"


def _enters(e: np.ndarray, x0: np.ndarray, y0: np.ndarray, size: float) -> np.ndarray:
    """(cells, edges): which edges (ax, ay, bx, by) have a point in which closed box."""
    x0, y0 = x0[:, None], y0[:, None]
    x1, y1 = x0 + size, y0 + size
    (ax, ay, bx, by) = e.T
    near = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    dx, dy = bx - ax, by - ay
    sides = [dx * (y - ay) - dy * (x - ax) for x in (x0, x1) for y in (y0, y1)]
    return near & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)


def _odd(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points have an odd number of edges to their east."""
    (ax, ay, bx, by), x, y = e.T, x[:, None], y[:, None]
    up = (by > y) != (ay > y)
    at = (ax - bx) * (y - by) / np.where(ay == by, 1.0, ay - by) + bx
    return (up & (x < at)).sum(axis=1) % 2 == 1


def _cells(rings: list[np.ndarray]) -> Iterator[tuple[int, int, int, list | None]]:
    """(level, column, row, edges per ring, None inside) of the cells that cover a polygon with holes."""
    every = np.concatenate(rings)
    lo, hi = every.reshape(-1, 2).min(axis=0), every.reshape(-1, 2).max(axis=0)
    extent = float(max(hi - lo)) or 1e-9
    size = lambda level: 360.0 / 2**level
    first = max((level for level in LEVELS if size(level) >= extent), default=LEVELS[0])
    span = lambda v, off: int(np.floor((v + off) / size(first)))
    grid = lambda xs, ys: tuple(g.ravel() for g in np.meshgrid(xs, ys))
    stack = [(first, *grid(np.arange(span(lo[0], 180.0), span(hi[0], 180.0) + 1), np.arange(span(lo[1], 90.0), span(hi[1], 90.0) + 1)), rings)]
    step = LEVELS[1] - LEVELS[0]
    inner = np.arange(1 << step)
    while stack:
        level, xs, ys, held = stack.pop()
        s = size(level)
        x0, y0 = xs * s - 180.0, ys * s - 90.0
        # A hair more on all sides: rounding may put a point that is on the line into either cell.
        hair = s * 1e-9
        n = sum(_enters(e, x0 - hair, y0 - hair, s + 2 * hair).sum(axis=1) for e in held)
        odd = [_odd(e, x0 + s / 2, y0 + s / 2) for e in held]
        for c in np.flatnonzero((n == 0) & odd[0] & ~np.logical_or.reduce([np.zeros(len(xs), bool), *odd[1:]])):
            yield level, int(xs[c]), int(ys[c]), None
        for c in np.flatnonzero(n):
            # What a ray to the east can meet from within: edges that reach into these rows and not only to the west.
            x, y = x0[c], y0[c]
            band = [e[(np.minimum(e[:, 1], e[:, 3]) <= y + s + hair) & (np.maximum(e[:, 1], e[:, 3]) >= y - hair) & (np.maximum(e[:, 0], e[:, 2]) >= x - hair)] for e in held]
            if level < LEVELS[-1] and (s * COARSEST > extent or n[c] > MANY_EDGES and s * FINEST > extent):
                k = 1 << step
                stack.append((level + step, *grid(xs[c] * k + inner, ys[c] * k + inner), band))
            else:
                yield level, int(xs[c]), int(ys[c]), [e.tolist() for e in band]


def covers(areas: DataFrame) -> DataFrame:
    """Cells of areas (area_id, rings: the boundary, then holes; each an array of closed paths' edges). Areas without an edge
    have none; they don't cross 180 degrees of longitude."""

    edge = pa.struct([(n, pa.float64()) for n in ("ax", "ay", "bx", "by")])
    kinds = pa.schema([("area_id", pa.int64()), ("_level", pa.int32()), ("_x", pa.int64()), ("_y", pa.int64()), ("edges", pa.list_(pa.list_(edge)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for area in batch.to_pylist():
                held = [np.array([[e["ax"], e["ay"], e["bx"], e["by"]] for e in ring], np.float64).reshape(-1, 4) for ring in area["rings"] or ()]
                if not held or not len(held[0]) or not np.isfinite(np.concatenate(held)).all():
                    continue
                for level, x, y, edges in _cells(held):
                    told = None if edges is None else [[dict(zip(("ax", "ay", "bx", "by"), e, strict=True)) for e in ring] for ring in edges]
                    rows.append({"area_id": area["area_id"], "_level": level, "_x": x, "_y": y, "edges": told})
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    dealt = areas.select("area_id", "rings").repartition(int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, COVER)


def containing(points: DataFrame, areas: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """points joined to the areas that contain them (``area_id``), by the even-odd rule, holes aside: the same rows as a
    test of all pairs. Points without a finite place are in none; extra columns stay."""
    x, y = F.col(lon), F.col(lat)
    at = F.array(*[F.struct(F.lit(level).alias("_level"), F.floor((x + 180.0) / (360.0 / 2**level)).alias("_x"), F.floor((y + 90.0) / (360.0 / 2**level)).alias("_y")) for level in LEVELS])
    finite = x.between(-180, 180) & y.between(-90, 90) & ~F.isnan(x) & ~F.isnan(y)
    placed = points.where(finite).withColumn("_at", F.explode(at)).select("*", "_at.*").drop("_at")
    # The size of points is guessed from their packed files, before they are dealt to levels: never broadcast by that.
    met = placed.hint("merge").join(covers(areas), ["_level", "_x", "_y"])
    return met.where(F.col("edges").isNull() | contains(F.col("edges"), x, y)).drop("_level", "_x", "_y", "edges")


def _copies(rows: DataFrame, id_: str, same: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows alike in ``same`` one each, told by its least id as ``name``; and (name, _g, name_ids): the ids of those alike in
    pieces, so that no row holds all copies. Ids are unique."""
    own = Window.partitionBy(*same).orderBy(id_)
    told = rows.select(id_, *same).withColumns({"_n": F.row_number().over(own), name: F.first(id_).over(own)})
    pieces = told.groupBy(name, F.floor((F.col("_n") - 1) / COPIES).alias(f"{name}_g")).agg(F.collect_list(id_).alias(f"{name}_ids"))
    return told.where("_n = 1").select(name, *same), pieces


def enclosed(points: DataFrame, areas: DataFrame, id_: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """(id_, area_id): the rows of ``containing`` by their ids. Their number is quadratic in the copies of a place and of a
    shape by nature, so a place meets a shape once, whatever the copies of both, and is tested once; what is dealt evenly to a
    set number of tasks then is pieces of ids that meet, and rows are only told from them."""
    places, points_of = _copies(points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()), id_, [lon, lat], "_place")
    shapes, areas_of = _copies(areas, "area_id", ["rings"], "_shape")
    met = containing(places, shapes.withColumnRenamed("_shape", "area_id"), lon, lat).select("_place", F.col("area_id").alias("_shape"))
    # Pieces are few and long: their size is guessed from ids alone, so never broadcast by that.
    pairs = met.hint("merge").join(points_of.hint("merge"), "_place").hint("merge").join(areas_of.hint("merge"), "_shape")
    dealt = pairs.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_place", "_place_g", "_shape", "_shape_g")
    return dealt.select(F.explode("_place_ids").alias(id_), "_shape_ids").select(id_, F.explode("_shape_ids").alias("area_id"))
