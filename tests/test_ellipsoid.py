"""Geodesics against published distances, against a numerical path, and as residual of the radius search."""

import math

import numpy as np
import pytest

from wayloom.functions.ellipsoid import A, FLAT, _far, metres
from wayloom.functions.geo import EARTH_M
from wayloom.operators.spatial import geodesic_join
from wayloom.plans import catalog
from wayloom.sources import catalog as c

dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
PUBLISHED = [
    (dms(-37, 57, 3.72030), dms(144, 25, 29.52440), dms(-37, 39, 10.15610), dms(143, 55, 35.38390), 54972.271),
    (40.6, -73.8, 51.6, -0.5, 5551759.400), (-41.32, 174.81, 40.96, -5.50, 19959679.267), (-30.0, 0.0, 29.9, 179.8, 19989832.827610),
    (-30.12345, 0.0, -30.12344, 0.00005, 4.944208), (0.0, 0.0, 0.5, 179.5, 19936288.579), (0.0, 0.0, 0.5, 179.7, 19944127.421), (0.0, 0.0, 0.0, 180.0, 20003931.458625), (0.0, 10.0, 0.0, 11.0, 111319.490793),
    (90.0, 0.0, -90.0, 55.0, 20003931.458625), (0.0, 0.0, 90.0, 33.0, 10001965.729313), (12.0, 34.0, 12.0, 34.0, 0.0), (5.0, 179.99, 5.0, -179.99, 2217.9),
]


@pytest.mark.parametrize("a,b,x,y,want", PUBLISHED)
def test_published_distances(a, b, x, y, want):
    got = metres(a, b, x, y)[0]
    assert abs(got - want) < (1e-3 if want != 2217.9 else 2) and abs(metres(x, y, a, b)[0] - got) < 1e-6 and abs(metres(-a, b + 77, -x, y + 77)[0] - got) < 1e-5


def test_both_ways_agree_and_keep_to_bounds():
    rng = np.random.default_rng(1)
    lat1, lat2, lon = rng.uniform(-90, 90, 3000), rng.uniform(-90, 90, 3000), rng.uniform(0, 175, 3000)
    got = metres(lat1, np.zeros(3000), lat2, lon)
    u = [np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2)]
    assert np.abs(got - _far(*u, np.radians(lon))).max() < 1e-4
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon) / 2) ** 2
    sphere = 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    assert (got / sphere).min() > 1 / 1.006 and (got / sphere).max() < 1.006
    # Near-antipodes: never longer than a way over a point between.
    p, q = rng.uniform(-60, 60, 400), rng.uniform(-1, 1, 400)
    far = metres(p, np.zeros(400), -p + q, 180 - rng.uniform(0, 1, 400))
    assert np.isfinite(far).all() and far.max() <= math.pi * A and far.min() > 1.97e7
    assert np.isnan(metres([np.nan, 0, 91], [0, np.inf, 0], [0, 0, 0], [0, 0, 0])).all()


def test_radius_search_on_the_ellipsoid_equals_all_pairs(spark, sf):
    rng = np.random.default_rng(2)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 1500), rng.uniform(-180, 180, 1500), strict=True))] + [(9000, None, 1.0), (9001, float("nan"), 1.0)]
    asked = [(i, float(a), float(b), float(r)) for i, (a, b, r) in enumerate(zip([0, 89.9, -45, 10], [179.9, 0, -179.99, 20], [9e5, 2e6, 1.5e6, 1e5], strict=True))]
    got = geodesic_join(spark.createDataFrame(asked, "q int, latitude double, longitude double, radius_m double"), spark.createDataFrame(points, "i int, latitude double, longitude double"), 2.0).collect()
    want = {(q, i): d for q, a, b, r in asked for i, x, y in points[:1500] if (d := metres(a, b, x, y)[0]) <= r}
    assert {(r.q, r.i) for r in got} == set(want) and len(want) > 60 and all(abs(r.distance_m - want[r.q, r.i]) < 1e-6 and r.radius_m == asked[r.q][3] for r in got)


def test_radius_query_equals_all_pairs(spark, sf):
    entities = {r.entity_id: (r.latitude, r.longitude) for r in c.geo_entity(spark, sf).collect()}
    verified = {r.experience_id for r in c.experience(spark, sf).where("status = 'VERIFIED'").collect()}
    want = {}
    for q, a, b, r, *_ in c.REQUESTS:
        ids = list(entities)
        d = dict(zip(ids, metres(np.full(len(ids), a), np.full(len(ids), b), [entities[i][0] for i in ids], [entities[i][1] for i in ids]), strict=True))
        for m in c.resolved_member(spark, sf).distinct().collect():
            if m.experience_id in verified and d[m.entity_id] <= r:
                want[q, m.experience_id] = min(d[m.entity_id], want.get((q, m.experience_id), math.inf))
    rows = catalog.QUERIES["op_geo_03_geodesic_radius"](spark, sf).collect()
    assert {(r.request_id, r.experience_id): r.distance_m for r in rows} == pytest.approx(want, abs=1e-4)
    for q in {r.request_id for r in rows}:
        own = sorted((r.rank, r.distance_m, r.experience_id) for r in rows if r.request_id == q)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1] for x in own] == sorted(x[1] for x in own)
