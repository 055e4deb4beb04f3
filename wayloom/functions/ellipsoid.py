"""Distances on the WGS 84 ellipsoid, vectorised, right for any two points.

Most pairs converge in a few steps of the classic iteration on the auxiliary sphere. Nearly antipodal ones don't: there
the azimuth at the point farther from the equator is found by bisection, since the longitude reached grows with it, and
both longitude and length are integrals of smooth functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values.
A, FLAT = 6378137.0, 1 / 298.257223563
B, SECOND = A * (1 - FLAT), (A**2 - (A * (1 - FLAT)) ** 2) / (A * (1 - FLAT)) ** 2
NODES, WEIGHTS = np.polynomial.legendre.leggauss(24)
STEPS, CLOSE, HALVINGS = 20, 1e-13, 60


def _near(u1: np.ndarray, u2: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """By iteration from reduced latitudes; NaN where it doesn't settle."""
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, done = turn.copy(), np.zeros(len(turn), bool)
    for _ in range(STEPS):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        cs = su1 * su2 + cu1 * cu2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.divide(cu1 * cu2 * sl, ss, out=np.zeros_like(ss), where=ss > 0)
        c2 = 1 - sa * sa
        mid = np.where(c2 > 0, cs - np.divide(2 * su1 * su2, c2, out=np.zeros_like(c2), where=c2 > 0), 0.0)
        c = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
        new = turn + (1 - c) * FLAT * sa * (sigma + c * ss * (mid + c * cs * (2 * mid * mid - 1)))
        done = np.abs(new - lam) < CLOSE
        lam = new
        if done.all():
            break
    k2 = c2 * SECOND
    a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    d = b * ss * (mid + b / 4 * (cs * (2 * mid**2 - 1) - b / 6 * mid * (4 * ss**2 - 3) * (4 * mid**2 - 3)))
    return np.where(done & (np.abs(lam) <= np.pi), B * a * (sigma - d), np.nan)


def _reached(alpha: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longitude, length) from u1 <= 0, |u2| <= |u1|, with the azimuth alpha, to the first time at u2 going up."""
    sa, ca = np.sin(alpha), np.cos(alpha)
    s1, c1, s2, c2 = np.minimum(np.sin(u1), -1e-150), np.cos(u1), np.sin(u2), np.cos(u2)
    s0 = sa * c1
    c0 = np.hypot(ca, sa * s1)
    up = np.sqrt(np.maximum(0.0, (ca * c1) ** 2 + (c2 - c1) * (c2 + c1)))
    sig1, sig2 = np.arctan2(s1, ca * c1), np.arctan2(s2, up)
    om1, om2 = np.arctan2(s0 * np.sin(sig1), np.cos(sig1)), np.arctan2(s0 * np.sin(sig2), np.cos(sig2))
    half = (sig2 - sig1) / 2
    at = (sig1 + sig2)[:, None] / 2 + half[:, None] * NODES
    root = np.sqrt(1 + SECOND * (c0**2)[:, None] * np.sin(at) ** 2)
    behind = half * ((2 - FLAT) / (1 + (1 - FLAT) * root) @ WEIGHTS)
    return np.mod(om2 - om1, 2 * np.pi) - FLAT * s0 * behind, B * half * (root @ WEIGHTS)


def _far(u1: np.ndarray, u2: np.ndarray, turn: np.ndarray) -> np.ndarray:
    swap = np.abs(u1) < np.abs(u2)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    down = np.where(u1 > 0, -1.0, 1.0)
    u1, u2 = u1 * down, u2 * down
    lo, hi = np.zeros(len(turn)), np.full(len(turn), np.pi)
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        short = _reached(mid, u1, u2)[0] < turn
        lo, hi = np.where(short, mid, lo), np.where(short, hi, mid)
    length = _reached((lo + hi) / 2, u1, u2)[1]
    # Along the equator no azimuth but east reaches less than (1 - f) half turns.
    return np.where((u1 == 0) & (u2 == 0) & (turn <= (1 - FLAT) * np.pi), A * turn, length)


def metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Geodesic distances; NaN where a coordinate isn't finite or a latitude isn't one."""
    lat1, lon1, lat2, lon2 = (np.atleast_1d(np.asarray(x, np.float64)) for x in (lat1, lon1, lat2, lon2))
    ok = np.isfinite(lat1) & np.isfinite(lon1) & np.isfinite(lat2) & np.isfinite(lon2) & (np.abs(lat1) <= 90) & (np.abs(lat2) <= 90)
    out = np.full(len(ok), np.nan)
    reduced = lambda lat: np.arctan2((1 - FLAT) * np.sin(np.radians(lat)), np.maximum(np.cos(np.radians(lat)), 0.0))
    u1, u2 = reduced(lat1[ok]), reduced(lat2[ok])
    turn = np.mod(lon2[ok] - lon1[ok], 360.0)
    turn = np.radians(np.minimum(turn, 360.0 - turn))
    found = _near(u1, u2, turn) if len(u1) else u1
    hard = np.isnan(found)
    if hard.any():
        found[hard] = _far(u1[hard], u2[hard], turn[hard])
    out[ok] = found
    return out


@F.pandas_udf(DoubleType())
def geodesic_m(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Metres between (lat1, lon1) and (lat2, lon2) in degrees; null where they aren't places."""
    for lat1, lon1, lat2, lon2 in parts:
        found = pd.Series(metres(*(x.to_numpy(np.float64, na_value=np.nan) for x in (lat1, lon1, lat2, lon2))))
        yield found.where(found.notna(), None)
