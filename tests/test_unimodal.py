import math

import numpy as np
import pytest

from quillon.operators import partition
from quillon.operators.mixture import fit_mixture, ks_p_value, ks_statistic, mixture, pg_means
from quillon.operators.spectral import log_bound, normalised_graph, special_k
from quillon.operators.unimodal import climb, default_starts, dip_ext, dip_init, dip_means, dip_n_sub, projected_dip_means, skinny_dip, tie_ranges


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "id long, features array<double>").cache()


def blobs(seed=1, n=60, centres=((0, 0, 0), (8, 0, 0), (0, 9, 0)), std=0.6):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, std, (n, len(c))) for c in centres]), np.repeat(np.arange(len(centres)), n)


def agreement(a, b):
    a, b = np.asarray(a), np.asarray(b)
    i, j = np.triu_indices(len(a), 1)
    return ((a[i] == a[j]) == (b[i] == b[j])).mean()


def labels(df):
    return [r["cluster"] for r in df.orderBy("id").collect()]


def test_dip_driven_splits(spark):
    x, true = blobs()
    points = table(spark, x)
    for model in (dip_means(points), projected_dip_means(points, random_axes=2)):
        assert model.k == 3 and agreement(true, labels(model.predict(points))) > 0.99
    assert dip_means(points, max_k=2).k == 2


def test_modal_intervals_by_dimension(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (150, 2)) for c in ((0, 0), (6, 0), (0, 6), (6, 6))])
    true = np.repeat(np.arange(4), 150)
    got = labels(skinny_dip(table(spark, x), outliers=False))
    assert set(got) == {0, 1, 2, 3} and agreement(true, got) > 0.97
    noisy = labels(skinny_dip(table(spark, x)))
    assert -1 in noisy and set(noisy) == {-1, 0, 1, 2, 3}


def test_multimodal_axes(spark):
    rng = np.random.default_rng(5)
    side = rng.integers(0, 2, 300)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), (side * 8 + rng.normal(0, 0.7, 300))[:, None]], axis=1)
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    points = table(spark, x @ turn)
    model = dip_ext(points, components=2)
    assert abs(model.axes[:, 0] @ turn[3]) > 0.97 and abs(model.axes[:, 0] @ model.axes[:, 1]) < 1e-6
    assert model.dips[0] > 0.05 and (np.diff(model.dips) <= 0).all()
    z = np.array([r["features"] for r in model.transform(points).collect()])
    assert z.max(0) == pytest.approx(model.dips) and z.min(0) == pytest.approx(0 * model.dips)
    assert dip_ext(points, ties="all", components=1).dips[0] >= 0.05 and dip_ext(points, ties="random", components=1).dips[0] >= 0.05
    init = dip_init(points, 2, components=2)
    assert agreement(side, labels(init.predict(points))) > 0.95
    sub = dip_n_sub(points)
    assert sub.n_clusters == 2 and agreement(side, labels(sub.labels)) > 0.95 and sub.axes.shape[0] == 4


def test_small_parts():
    #: Numbers of starts and ties.
    assert [default_starts(d) for d in (2, 3, 50)] == [1, 2, 4]
    value, axis = climb(np.array([1.0, 0.0, 0.0]), lambda v: (float(-((v - np.array([0.0, 0.6, 0.8])) ** 2).sum()), -2 * (v - np.array([0.0, 0.6, 0.8]))))
    assert value > -1e-4 and np.allclose(axis, [0, 0.6, 0.8], atol=1e-2)
    assert tie_ranges(np.array([0, 1, 1, 1, 1, 2, 2, 3, 4.0]), (1, 4, 6)) == [[1, 2, 3], [2, 3, 4], [5, 6]]


def test_mixtures(spark):
    x, true = blobs(std=0.8)
    points = table(spark, x)
    model = mixture(points, 3, repeats=2)
    assert agreement(true, labels(model.predict(points))) > 0.99
    from collections import Counter

    assert sorted(Counter(labels(model.predict(points))).values()) == [60, 60, 60]
    # one component: closed form
    one = mixture(points, 1)
    assert np.allclose(one.means[0], x.mean(0)) and np.allclose(one.covariances[0], np.cov(x.T, bias=True), atol=1e-4)
    plain = -0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(one.covariances[0])[1]) - 0.5 * np.einsum("ij,jk,ik->i", x - one.means[0], np.linalg.inv(one.covariances[0]), x - one.means[0])
    assert np.allclose(one.log_likelihood(x), plain)
    diag = fit_mixture(points, model.means, "diag")
    assert np.allclose(diag.covariances[0], np.diag(np.diag(diag.covariances[0])))
    found = pg_means(points, 0.05, projections=24, seed=1, max_k=6)
    assert found.mixture.k == 3 and agreement(true, labels(found.mixture.predict(points))) > 0.99


def test_two_sample_distance(spark):
    rng = np.random.default_rng(2)
    for a, b in ((rng.normal(size=80), rng.normal(1, 1, 50)), (rng.integers(0, 5, 60).astype(float), rng.integers(1, 6, 40).astype(float))):
        frame = spark.createDataFrame([(float(v),) for v in a], "x double")
        at = np.concatenate([a, b])
        plain = max(abs((a <= t).mean() - (b <= t).mean()) for t in at)
        assert ks_statistic(frame, b)[0] == pytest.approx(plain, abs=1e-9)
    assert ks_p_value(0.01, 100, 100) > 0.99 and ks_p_value(0.6, 100, 100) < 1e-6


def test_normal_distribution_function():
    z = np.concatenate([np.linspace(-5, 5, 501), [-30, -8, 8, 30]])
    plain = [math.log(math.erfc(-v / math.sqrt(2)) / 2) for v in z[z > -30]]
    assert np.allclose(partition.log_normal_cdf(z)[z > -30], plain, rtol=1e-7, atol=1e-9)
    assert partition.log_normal_cdf(np.array([-30.0]))[0] == pytest.approx(-454.3212, abs=1e-3)


def test_spectral_number_of_clusters(spark):
    x, true = blobs(n=30, std=0.3, centres=((0, 0), (20, 0), (0, 20)))
    points = table(spark, x)
    w = normalised_graph(points, 5)
    assert {(r["i"], r["j"]): round(r["w"], 9) for r in w.collect()} == {(r["j"], r["i"]): round(r["w"], 9) for r in w.collect()}
    got, k = special_k(points, neighbours=10)
    assert k >= 1 and got.count() == 90
    # by definition, from loops
    rng = np.random.default_rng(0)
    for d in (rng.normal(size=(40, 3)), np.repeat([[0.0, 9, 1], [9, 0, 1]], 200, axis=0) + rng.normal(0, 0.1, (400, 3))):
        half = len(d) // 2
        norms = [math.sqrt(sum(v * v for v in col)) or 1 for col in d.T]
        z = [[(d[i][j] - d[:, j].mean()) / norms[j] for j in range(3)] for i in range(len(d))]
        variance = sum(v * v for r in z for v in r) / (3 * len(d))
        t = max(sum(sum(r[j] for r in part) ** 2 for j in range(3)) / half for part in (z[:half], z[half:])) - variance * 3
        want = min(0.0, math.log(len(d)) - 0.5 * t * t / (3 * variance + t / 3))
        assert log_bound(d, np.arange(half), np.arange(half, len(d))) == pytest.approx(want)


def test_splits_are_checked_and_merged(spark):
    x, true = blobs(n=80)
    points = table(spark, x)
    model = partition.xmeans(points, 2)
    assert model.k == 3 and agreement(true, labels(model.predict(points))) > 0.99
    six = partition.lloyd(points, np.concatenate([x[::30][:6]]))
    assert partition.merge_by_bic(points, six).k < six.k
    assert partition.global_bic(points, model) > partition.global_bic(points, six)
    assert partition.xmeans(points, 6, allow_merging=True).k <= 6
