"""Operators on vectors against brute force."""

import numpy as np
import pytest

from wayloom.llm.caps import near_vectors
from wayloom.llm.common import Scratch
from wayloom.llm.curves import hilbert, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 64))
    x[200:300] = x[:100] + 0.15 * rng.normal(size=(100, 64))
    x[300:340] = x[0] + 0.02 * rng.normal(size=(40, 64))
    x[340:360] = x[5] * 2
    rows = [(i, [float(v) for v in r.astype(np.float32)], 0, 7) for i, r in enumerate(x)]
    odd = [(1000, None, 0, 1), (1050, [0.0] * 64, 0, 1), (1100, [float("nan")] * 64, 0, 1), (1150, [None] + [1.0] * 63, 0, 1), (1200, [1.0, 2.0], 0, 1), (1250, [], 0, 1), (None, rows[0][1], 0, 1), (7, rows[7][1], 1, 1)]
    return spark.createDataFrame(rows + odd, SCHEMA)


def usable(df):
    rows = [r for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and None not in r.embedding]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    ok = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
    x = x[ok]
    return ids[ok], x / np.linalg.norm(x, axis=1, keepdims=True)


def test_near_vectors_equal_brute_force(spark, vectors):
    ids, x = usable(vectors)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low, 1 << 60).min(axis=1))
        if (new == low).all():
            break
        low = new
    want = sorted(zip(ids.tolist(), near.sum(axis=1).tolist(), low.tolist(), strict=True))
    want += [(i, 0, i) for i in range(1000, 1251, 50)]
    got = near_vectors(vectors, Scratch(spark, "t"))
    rows = got.collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows if r.vec_id is not None) == sorted(want)
    assert [(r.n_links, r.component_id) for r in rows if r.vec_id is None] == [(0, None)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    assert near_vectors(vectors.limit(0), Scratch(spark, "t")).count() == 0


def test_near_vectors_of_a_large_table(spark):
    """12,000 vectors with groups of near copies from two to 2,000 and exact copies: no link is missed or made up."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(12_000, 64))
    x[1000:3000] = x[0] + 0.12 * rng.normal(size=(2000, 64))  # a group of very many, some links of it missing
    for k, n in enumerate((2, 3, 5, 17, 60, 200) * 4):
        at = 3000 + 300 * k
        x[at : at + n] = x[k + 1] + rng.uniform(0.1, 0.26) * rng.normal(size=(n, 64))
    x[11_000:11_400] = x[900]
    ids = rng.permutation(12_000) * 3
    x = x.astype(np.float32)
    docs = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(6)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    low = ids.copy()
    while True:
        was = low.copy()
        np.minimum.at(low, i, low[j])
        if (was == low).all():
            break
    want = {(int(a), int(n), int(c)) for a, n, c in zip(ids, near.sum(axis=1), low, strict=True)}
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_vectors(docs, Scratch(spark, "t")).collect()}
    assert len(got & want) >= 0.999 * len(want)
    assert sum(n for _, n, _ in got) >= 0.999 * near.sum()


def test_lengths_are_those_of_the_table(spark):
    """Whatever batch a row is in, vectors of the table's usual length count and others don't."""
    rows = [(i, [1.0, 0.01 * (i % 2), 0.0]) for i in range(40)] + [(100 + i, [1.0, 0.0]) for i in range(20)]
    for parts in (1, 13):
        docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(docs, Scratch(spark, "t")).collect()}
        assert all(got[i] == (39, 0) for i in range(40)) and all(got[i] == (0, i) for i in range(100, 120))


def brute_nearest(ids, x, every, k=5):
    """{query row: [(id, score)]} of all rows but the query's own, by the plain formula."""
    x = np.asarray(x, float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(np.asarray(ids) % every == 0):
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        order = np.lexsort((ids, -s))
        out[q] = [(int(ids[i]), float(s[i])) for i in order[order != q][:k]]
    return out


def test_nearest_of_a_small_table_is_exact(spark, vectors):
    """With nulls, other lengths, copies, a repeated id and scaled copies; ties go to the smaller id."""
    rows = [r for r in vectors.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and None not in r.embedding]
    rows = [r for r in rows if np.isfinite(r.embedding).all() and np.abs(r.embedding).max() > 0]
    ids = np.array([r.vec_id for r in rows])
    want = sorted((int(ids[q]), tuple(i for i, _ in near)) for q, near in brute_nearest(ids, [r.embedding for r in rows], 10).items())
    found = {}
    for r in nearest(vectors, Scratch(spark, "t"), every=10, least=10_000).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [(q, tuple(i for _, i, _ in sorted(v))) for q, v in sorted(found.items())] == want
    assert nearest(vectors.limit(3), Scratch(spark, "t")).count() == 2
    assert nearest(vectors.limit(0), Scratch(spark, "t")).count() == 0


def test_nearest_ties_and_own_row(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200, -1, -1)] + [(0, [1.0, 2.0, 3.0]), (50, [3.0, 1.0, 0.5])] + [(900 + i, [float(i), 1.0, 0.0]) for i in range(9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(docs, Scratch(spark, "t")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    tens = {q: sorted(v) for q, v in got.items()}
    assert tens[100] == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]
    assert tens[0] == sorted([(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)] * 2)  # two rows of that id, each sees the other
    assert len(tens[50]) == 10 and (1, 0) in tens[50]


def test_nearest_recall_where_windows_prune(spark):
    """10,500 vectors, a third of them one group of copies and close copies."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(10_500, 64))
    x[:1500] = x[0]
    x[1500:3500] = x[0] + 0.05 * rng.normal(size=(2000, 64))
    ids = rng.permutation(len(x))
    x = x.astype(np.float32)
    docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in nearest(docs, Scratch(spark, "t")).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {int(ids[q]): near for q, near in brute_nearest(ids, x, 50).items()}
    assert sorted(got) == sorted(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    apart = [q for q in want if want[q][0][1] < 0.9]
    alone = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in apart)
    print("recall", hits / (5 * len(want)), "of vectors alone", alone / (5 * len(apart)))
    assert hits / (5 * len(want)) >= 0.9 and alone / (5 * len(apart)) >= 0.9
    copies = {int(i) for i in ids[:1500]}
    low = sorted(copies)[:6]
    for q in copies & set(want):
        assert [i for i, _ in sorted(got[q], key=lambda z: (-z[1], z[0]))] == [i for i in low if i != q][:5]


def test_hilbert_visits_neighbours():
    side = 16
    cells = np.array([(a, b) for a in range(side) for b in range(side)])
    path = cells[np.argsort(hilbert(cells, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
