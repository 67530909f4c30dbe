import numpy as np
import pytest

from quillon.deep.autograd import Tensor, squared_distances
from quillon.deep.clustering import acedec, aec, dcn, dec, default_alphas, dkm, embedded_density_peaks, embedded_mixture, enrc, idec, shade, soft_assignment, target_distribution
from quillon.deep.networks import Autoencoder, epoch, pretrain, reconstruction, variational
from quillon.operators.dctree import dc_tree


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    true = np.repeat(np.arange(3), 50)
    x = rng.normal(0, 0.25, (150, 5)) + np.array([[0, 0, 0, 0, 0], [3, 3, 0, 0, 0], [0, 0, 3, 3, 0]])[true]
    points = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, features array<double>").repartition(2).cache()
    return points, true, x


def agreement(a, b):
    a, b = np.asarray(a), np.asarray(b)
    i, j = np.triu_indices(len(a), 1)
    return ((a[i] == a[j]) == (b[i] == b[j])).mean()


def labels(df):
    return [r["cluster"] for r in df.orderBy("id").collect()]


def test_derivatives_follow_differences():
    rng = np.random.default_rng(1)
    net = Autoencoder.create((4, 3, 2), 1)
    vae = Autoencoder.create((4, 3, 2), 1, True)
    x, c = rng.normal(size=(6, 4)), rng.normal(size=(3, 2))

    def membership(x, p, rng):
        q = soft_assignment(squared_distances(net.encode(Tensor(x), p), p["centres"]))
        soft = (squared_distances(net.encode(Tensor(x), p), p["centres"]) * -2.0).softmax()
        return -(q.log()).sum(1).mean() + (soft * q).sum() + net.encode(Tensor(x), p).abs().mean() + net.encode(Tensor(x), p).sigmoid().sum() - p["centres"][np.array([0, 0, 2])].mean()

    for own, loss, more in ((net, reconstruction(net), {}), (vae, variational(vae, 0.5), {}), (net, membership, {"centres": c})):
        start = {**own.parameters, **more}
        value = lambda p: float(loss(x, {k: Tensor(v) for k, v in p.items()}, np.random.default_rng(3)).data)  # noqa: B023, E731
        p = {k: Tensor(v) for k, v in start.items()}
        loss(x, p, np.random.default_rng(3)).backward()
        for name, v in start.items():
            at = tuple(rng.integers(0, s) for s in v.shape)
            step = np.zeros_like(v)
            step[at] = 1e-6
            slope = (value({**start, name: v + step}) - value({**start, name: v - step})) / 2e-6
            assert p[name].grad[at] == pytest.approx(slope, rel=1e-4, abs=1e-6), name


def test_training_is_repeatable_and_learns(blobs):
    points, _, x = blobs
    net, losses = pretrain(points, (5, 8, 2), 40, 32, 1e-2)
    assert losses[-1] < 0.3 * losses[0]
    again, same = pretrain(points, (5, 8, 2), 3, 32, 1e-2)
    assert same == pytest.approx(losses[:3])
    z = np.array([r["features"] for r in net.transform(points).orderBy("id").collect()])
    assert np.allclose(z, net.embed(x)) and z.shape == (150, 2)
    p, _ = epoch(points, net.parameters, reconstruction(net), 32, 1e-2, 0, frozenset(net.parameters))
    assert all(np.allclose(p[k], net.parameters[k]) for k in p)


def test_targets_sharpen():
    q = np.array([[0.9, 0.1], [0.6, 0.4], [0.2, 0.8]])
    p = target_distribution(q)
    assert np.allclose(p.sum(1), 1) and (p.max(1) > q.max(1)).all()
    assert np.allclose(soft_assignment(Tensor([[0.0, 3.0]])).data, [[0.8, 0.2]])
    alphas = default_alphas(4)
    assert alphas[0] == 0.1 and all(a < b for a, b in zip(alphas, alphas[1:]))


def test_methods_find_blobs(blobs):
    points, true, _ = blobs
    net, _ = pretrain(points, (5, 8, 2), 40, 32, 1e-2)
    common = {"layers": (5, 8, 2), "net": net, "epochs": 3, "batch": 32, "rate": 1e-3}
    for fit in (dec, idec, dcn, aec, dkm, acedec):
        model = fit(points, 3, **common, **({"start_repeats": 1} if fit is acedec else {}))
        assert len(model.losses) == 3 and agreement(true, labels(model.predict(points))) > 0.95, fit
    several = enrc(points, (3, 2), **common, start="random")
    assert several.weights.shape == (2, 2) and np.allclose(several.weights.sum(0), 1) and several.centres.shape == (5, 2)
    assert agreement(true, labels(embedded_mixture(points, 3, (5, 8, 2), net=net).predict(points))) > 0.95
    found, k = embedded_density_peaks(points, (5, 8, 2), net=net)
    assert k >= 2 and found.count() == 150


def test_density_connected_embedding(blobs):
    points, true, _ = blobs
    tree = dc_tree(points, 5)
    i, j = np.triu_indices(150, 1)
    assert np.allclose(tree.table_arrays().distances(i, j), tree.dc_distances()[i, j])
    model = shade(points, 3, (5, 8, 2), epochs=15, batch=32, rate=1e-2)
    assert model.losses[-1] < model.losses[0] and agreement(true, labels(model.predict(points))) > 0.8
