"""VaDE, DipDECK, N2D and DDC."""

import numpy as np
import pytest

from quillon.deep.autograd import Tensor
from quillon.deep.dipdeck import dip_deck, dip_matrix, dip_of_histogram
from quillon.deep.manifold import ddc, n2d
from quillon.deep.networks import Autoencoder, pretrain
from quillon.deep.vade import Prior, evidence_loss, updated_prior, vade
from quillon.functions.dip import dip_test, p_value_of
from tests.test_deep import agreement, labels


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    true = np.repeat(np.arange(3), 50)
    x = rng.normal(0, 0.25, (150, 5)) + np.array([[0, 0, 0, 0, 0], [3, 3, 0, 0, 0], [0, 0, 3, 3, 0]])[true]
    points = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, features array<double>").repartition(2).cache()
    return points, true, x


@pytest.fixture(scope="module")
def net(blobs):
    return pretrain(blobs[0], (5, 8, 2), 40, 32, 1e-2)[0]


def test_evidence_follows_differences():
    rng = np.random.default_rng(2)
    net = Autoencoder.create((4, 3, 2), 1, True)
    prior = Prior(np.array([0.2, 0.5, 0.3]), rng.normal(size=(3, 2)), rng.uniform(0.3, 2, (3, 2)))
    x = rng.normal(size=(6, 4))
    loss = evidence_loss(net, prior, 0.7)
    value = lambda p: float(loss(x, {k: Tensor(v) for k, v in p.items()}, np.random.default_rng(3)).data)
    p = {k: Tensor(v) for k, v in net.parameters.items()}
    loss(x, p, np.random.default_rng(3)).backward()
    for name, v in net.parameters.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        step = np.zeros_like(v)
        step[at] = 1e-6
        slope = (value({**net.parameters, name: v + step}) - value({**net.parameters, name: v - step})) / 2e-6
        assert p[name].grad[at] == pytest.approx(slope, rel=1e-4, abs=1e-6), name
    # the joint density, from its definition
    z = rng.normal(size=(5, 2))
    want = np.array([[np.log(prior.weights[c]) + sum(-0.5 * np.log(2 * np.pi * v) - (a - m) ** 2 / (2 * v) for a, m, v in zip(r, prior.means[c], prior.variances[c])) for c in range(3)] for r in z])
    assert np.allclose(prior.log_joint(z).data, want)


def test_prior_is_updated_by_weighted_moments(spark, blobs):
    points, _, x = blobs
    net = Autoencoder.create((5, 4, 2), 3, True)
    z, log_var = (t.data for t in net.moments(Tensor(x), {k: Tensor(v) for k, v in net.parameters.items()}))
    prior = Prior(np.array([0.5, 0.5]), z[[0, 60]], np.ones((2, 2)))
    g = prior.members(z)
    means = (g.T @ z) / g.sum(0)[:, None]
    new = updated_prior(points, net, prior)
    assert np.allclose(new.weights, g.mean(0)) and np.allclose(new.means, means)
    assert np.allclose(new.variances, np.maximum((g.T @ (z**2 + np.exp(log_var))) / g.sum(0)[:, None] - means**2, 1e-3))


def test_vade_finds_blobs(blobs):
    points, true, _ = blobs
    model = vade(points, 3, (5, 8, 2), pretrain_epochs=40, epochs=4, batch=32, rate=5e-3)
    assert agreement(true, labels(model.predict(points))) > 0.95 and model.losses[-1] < model.losses[0]
    with pytest.raises(ValueError):
        vade(points, 3, (5, 2), net=Autoencoder.create((5, 2)))


def test_dips_of_histograms():
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=500), np.concatenate([rng.normal(-3, 1, 300), rng.normal(3, 1, 200)]), rng.random(64)):
        low, high = x.min(), x.max()
        counts = np.histogram(x, 2048, (low, high))[0]
        assert dip_of_histogram(counts, low, high) == pytest.approx(dip_test(x).value, abs=counts.max() / len(x))
    assert dip_of_histogram(np.array([3]), 0, 1) == 0 and dip_of_histogram(np.array([9]), 1, 1) == 0


def test_dip_matrix_against_pairs(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0.0, 0], [1.0, 0], [9, 0], [50, 50]])
    x = np.concatenate([rng.normal(c, 1.2, (n, 2)) for c, n in zip(centres[:3], (120, 120, 200))])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(3)
    dips, sizes = dip_matrix(rows, centres, bins=4096, factor=10.0)
    at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    assert sizes.tolist() == np.bincount(at, minlength=4).tolist() and (dips[3, :3] == 0).all()
    for a, b in ((0, 1), (0, 2), (1, 2)):
        z = x[(at == a) | (at == b)] @ (centres[b] - centres[a])
        assert dips[a, b] == pytest.approx(p_value_of(dip_test(z).value, len(z)), abs=0.05)
    assert dips[0, 1] > 0.5 and dips[0, 2] < 0.05


def test_dip_deck_shrinks_to_the_truth(blobs, net):
    points, true, _ = blobs
    model = dip_deck(points, 6, (5, 8, 2), merge_at=0.3, epochs=2, batch=32, net=net)
    assert model.k == 3 and len(model.counts) == 2
    assert agreement(true, labels(model.predict(points))) > 0.95
    assert dip_deck(points, 3, (5, 8, 2), epochs=0, most=2, net=net).k == 2


def test_placements_are_clustered(blobs, net):
    points, true, _ = blobs
    options = {"dims": 2, "neighbours": 8, "landmarks": 12}
    found = n2d(points, 3, (5, 8, 2), options=options, net=net)
    assert agreement(true, labels(found.labels)) > 0.95 and found.placement.count() == 150
    few = points.where("id % 5 = 0").cache()
    peaks = ddc(few, (5, 8, 2), method="isomap", options=options | {"neighbours": 4}, net=net)
    assert peaks.n_clusters >= 1 and peaks.labels.count() == 30
