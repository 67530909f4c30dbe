import math

import numpy as np
import pytest

from quillon.functions.gaussian import bic_costs, common_costs, gaussian_costs, generalised_eigen, integer_costs, mixture_costs, probability_costs
from quillon.operators.subspace import auto_nr, clustering_in_orthogonal_spaces, closest_centres, lda_kmeans, mdl_progress, merge_nearest, nr_kmeans, orthogonal_clustering, principal_axes, smallest_gaps, sub_kmeans
from quillon.sources.synthetic import nr_data, subspace_data


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "id long, features array<double>")


def agreement(a, b):
    """Share of pairs on which two labelings agree."""
    a, b = np.asarray(a), np.asarray(b)
    i, j = np.triu_indices(len(a), 1)
    return ((a[i] == a[j]) == (b[i] == b[j])).mean()


def test_description_lengths():
    assert bic_costs(3, True) == pytest.approx(0.792481250360578) and bic_costs(3) == pytest.approx(0.5493061443340549)
    assert integer_costs(77, True) == pytest.approx(12.328150766) and integer_costs(77) == pytest.approx(7.24955913584)
    assert probability_costs(1 / 33) == pytest.approx(5.044394119) and probability_costs(0) == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) @ np.diag([1, 2, 3])
    s = (x - x.mean(0)).T @ (x - x.mean(0))
    d = x - x.mean(0)
    for kind, cov in (("full", s / 50), ("diag", np.diag(np.diag(s)) / 50), ("spherical", np.eye(3) * np.trace(s) / 150)):
        bits = sum(0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + r @ np.linalg.inv(cov) @ r) for r in d) / math.log(2)
        assert gaussian_costs(3, s, 50, None, kind) == pytest.approx(bits)
        assert mixture_costs(3, [s, s], [50, 50], None, kind) == pytest.approx(2 * bits)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    assert common_costs(3, s, 50, turn, "full") == pytest.approx(gaussian_costs(3, s, 50, None, "full"))
    assert gaussian_costs(3, s, 1) == 0 and gaussian_costs(3, 0 * s, 50) == 0
    a, b = s, np.diag([1.0, 2, 3])
    w, v = generalised_eigen(a, b)
    assert np.allclose(a @ v, b @ v * w, atol=1e-5) and (np.diff(w) <= 0).all()


def test_gaps_and_centres(spark):
    #: A published matrix whose precision is 2.
    assert smallest_gaps(table(spark, [[0, 0, 0, 0], [1, 2, 3, 0], [10, 11, 12, 0], [20, 21, 22, 0]])) == 2
    c = np.array([[0.0, 0], [5, 5], [5, 6], [9, 0]])
    assert closest_centres(c) == (1, 2) and merge_nearest(c).tolist() == [[0, 0], [9, 0], [5, 5.5]]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ np.diag([5, 1, 0.1])
    mean, axes, var = principal_axes(table(spark, x), 0.9)
    assert axes.shape == (3, 1) and var[0] == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[-1]) and np.allclose(mean, x.mean(0))


def test_two_hidden_labelings(spark):
    rng = np.random.default_rng(4)
    corners = np.array([[0, 9], [9, 0], [-8, -8.0]])
    true = rng.integers(0, 3, (300, 2))
    x = np.concatenate([corners[true[:, 0]], corners[true[:, 1]], np.zeros((300, 2))], axis=1) + rng.normal(0, 0.5, (300, 6))
    x = x @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    points = spark.createDataFrame([(k, p.tolist(), t.tolist()) for k, (p, t) in enumerate(zip(x, true))], "id long, features array<double>, labels array<int>").cache()
    best = min((nr_kmeans(points, [3, 3, 1], seed=s) for s in range(6)), key=lambda m: m.cost())
    rows = best.predict(points.withColumnRenamed("labels", "true"), "labels").collect()
    true, found = np.array([r["true"] for r in rows]), np.array([r["labels"] for r in rows])
    hits = [max(agreement(true[:, t], found[:, s]) for s in range(2)) for t in range(2)]
    assert min(hits) > 0.95
    assert np.allclose(best.rotation @ best.rotation.T, np.eye(6))
    assert sorted(c for s in best.spaces for c in s.columns) == list(range(6))
    z = np.array([r["features"] for r in best.transform(points, 0).orderBy("id").collect()])
    x = np.array([r["features"] for r in points.orderBy("id").collect()])
    assert np.allclose(z, x @ best.axes(0))
    own = best.labels(x)
    for s, space in enumerate(best.spaces):
        within = sum(((x[own[:, s] == c] - x[own[:, s] == c].mean(0)).T @ (x[own[:, s] == c] - x[own[:, s] == c].mean(0)) for c in range(space.k)))
        assert np.allclose(within, space.scatter, atol=1e-6) and space.counts.sum() == 300


def test_outliers_noise_space_and_bits(spark):
    points = nr_data(spark, 200, (3, 1), (2, 2), outliers=(6, 0), std=0.3, seed=2).cache()
    model = min((nr_kmeans(points, [3, 1], mdl_for_noise=True, outliers=True, seed=s) for s in range(3)), key=lambda m: m.mdl()[0])
    total, whole, each = model.mdl()
    assert total == pytest.approx(whole + sum(each)) and model.spaces[-1].k == 1
    flat = model.without_noise()
    assert [s.k for s in flat.spaces] == [3] and flat.spaces[0].dims == 4
    assert len(model.without_noise(False, 1).spaces) == 1
    with pytest.raises(ValueError):
        nr_kmeans(points, [1, 1])


def test_subspace_estimators(spark):
    points = subspace_data(spark, 240, 3, (2, 3), std=0.4, seed=3).cache()
    true = [r["label"] for r in points.orderBy("id").collect()]
    sub = sub_kmeans(points, 3, 3)
    got = [r["labels"][0] for r in sub.predict(points).orderBy("id").collect()]
    assert agreement(true, got) > 0.95 and [s.k for s in sub.spaces] == [3, 1]
    lda = lda_kmeans(points, 3, repeats=2)
    got = [r["cluster"] for r in lda.predict(points).orderBy("id").collect()]
    assert agreement(true, got) > 0.95 and lda.axes.shape == (5, 2)
    assert len(lda.transform(points).first()["features"]) == 2


def test_orthogonal_clusterings(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    x = np.stack([a * 20 + rng.normal(0, 0.5, 200), b * 10 + rng.normal(0, 0.5, 200), rng.normal(0, 0.5, 200)], axis=1)
    points = table(spark, x)
    for build in (orthogonal_clustering, clustering_in_orthogonal_spaces):
        model = build(points, (2, 2), 0.9)
        rows = np.array([r["labels"] for r in model.predict(points).orderBy("id").collect()])
        assert agreement(a, rows[:, 0]) > 0.95 and agreement(b, rows[:, 1]) > 0.9
        assert len(model.transform(points, 1).first()["features"]) == 3
    assert np.allclose(clustering_in_orthogonal_spaces(points, (2,)).residual(x, 0), x - x.mean(0))


def test_subspaces_and_clusters_by_description_length(spark):
    points = nr_data(spark, 150, (3, 1), (2, 1), (0, 0), std=0.3, seed=5).cache()
    found = auto_nr(points, repeats=2, max_clusters=5)
    assert found.model.mdl()[0] < found.progress[0][2]
    assert any(s.k == 3 for s in found.model.spaces)
    log = mdl_progress(spark, found)
    assert log.count() == len(found.progress) and log.where("accepted").count() >= 2
