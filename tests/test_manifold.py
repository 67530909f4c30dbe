"""Geodesics, Isomap and t-SNE against dense loops."""

import math

import numpy as np
import pytest

from quillon.operators import manifold


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "id long, features array<double>")


def rolled(n, seed=0):
    """A sheet rolled up in three dimensions, and its two own coordinates."""
    rng = np.random.default_rng(seed)
    t, h = 1.5 * math.pi * (1 + 2 * rng.random(n)), 20 * rng.random(n)
    return np.stack([t * np.cos(t), h, t * np.sin(t)], 1), t


def floyd(edges, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for i, j, w in edges:
        d[i, j] = min(d[i, j], w)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


def test_isomap_is_classical_scaling_of_shortest_paths(spark):
    x, _ = rolled(200)
    points = table(spark, x)
    edges = manifold.neighbour_graph(points, 8).cache()
    d = floyd([tuple(r) for r in edges.collect()], 200)
    assert np.isfinite(d).all()
    marks = [5, 77, 140]
    got = np.array([r["g"] for r in manifold.geodesics(edges, points.select("id"), marks).orderBy("id").collect()])
    assert np.allclose(got, d[:, marks])
    place = np.array([r["features"] for r in manifold.isomap(points, 2, 8, landmarks=60).orderBy("id").collect()])
    apart = np.sqrt(((place[:, None] - place[None]) ** 2).sum(2))
    stress = math.sqrt(((apart - d) ** 2).sum() / (d**2).sum())
    j = np.eye(200) - 1 / 200
    values, vectors = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    whole = vectors[:, -2:] * np.sqrt(values[-2:])
    best = np.sqrt(((whole[:, None] - whole[None]) ** 2).sum(2))
    assert stress < 1.3 * math.sqrt(((best - d) ** 2).sum() / (d**2).sum()) + 0.02


def test_all_landmarks_are_exact(spark):
    x, _ = rolled(60, 1)
    points = table(spark, x)
    d = floyd([tuple(r) for r in manifold.neighbour_graph(points, 6).collect()], 60)
    j = np.eye(60) - 1 / 60
    values, vectors = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    got = np.array([r["features"] for r in manifold.isomap(points, 2, 6).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6 * np.abs(want).max())


def test_parts_are_joined(spark):
    x = np.concatenate([np.random.default_rng(k).normal(30 * k, 1, (12, 2)) for k in range(3)])
    edges = [tuple(r) for r in manifold.neighbour_graph(table(spark, x), 3).collect()]
    assert np.isfinite(floyd(edges, 36)).all()
    across = sorted(w for i, j, w in edges if i // 12 != j // 12)
    gap = lambda a, b: min(np.linalg.norm(p - q) for p in x[12 * a : 12 * a + 12] for q in x[12 * b : 12 * b + 12])
    assert across == pytest.approx(sorted([gap(0, 1), gap(1, 2)] * 2))


def test_affinities_and_gradient(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    points = table(spark, x)
    pairs = manifold.affinities(points, 8).cache()
    p = np.zeros((60, 60))
    for i, j, v in pairs.collect():
        p[i, j] = v
    assert p.sum() == pytest.approx(1) and np.allclose(p, p.T)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(np.where(np.eye(60, dtype=bool), np.inf, d2), axis=1)[:, :24]
    for i in range(3):
        own = manifold._bandwidths(d2[i, near[i]], 8)
        assert math.exp(-(own * np.log(own)).sum()) == pytest.approx(8, rel=1e-4)
    y = rng.normal(0, 3, (60, 2))
    state = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "id long, y array<double>")
    got = [np.array([r["g"] for r in manifold.with_gradient(pairs, state, boxes).orderBy("id").collect()]) for boxes in (15, 80)]
    diff = y[:, None] - y[None]
    q = 1 / (1 + (diff**2).sum(2))
    np.fill_diagonal(q, 0)
    want = 4 * (((p - q / q.sum()) * q)[:, :, None] * diff).sum(1)
    coarse, fine = (np.abs(g - want).max() / np.abs(want).max() for g in got)
    assert fine < 1e-3 and coarse < 0.05


def test_tsne_parts_blobs(spark):
    rng = np.random.default_rng(3)
    true = np.repeat(np.arange(3), 20)
    x = rng.normal(0, 0.3, (60, 5)) + 4 * np.eye(5)[true]
    got = np.array([r["features"] for r in manifold.tsne(table(spark, x), 6, iterations=14, exaggerated=10, rate=5.0, spread=1.0, boxes=15).orderBy("id").collect()])
    centres = np.array([got[true == k].mean(0) for k in range(3)])
    assert (((got[:, None] - centres) ** 2).sum(2).argmin(1) == true).mean() > 0.95
