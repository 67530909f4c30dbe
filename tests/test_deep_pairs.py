"""DipEncoder, DEN, the neighbour encoder, and the starts and repairs of ENRC."""

import numpy as np
import pytest

from quillon.deep.autograd import Tensor
from quillon.deep.clustering import enrc, enrc_start, lost_centres_remade, space_costs
from quillon.deep.dipencoder import dip_encoder, dip_loss, dip_tensor, pair_thresholds
from quillon.deep.neighbours import den, den_loss, neighbour_encoder, neighbour_loss, with_neighbours
from quillon.deep.networks import Autoencoder
from quillon.functions.dip import dip_test
from tests.test_deep import agreement, labels


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    true = np.repeat(np.arange(3), 40)
    x = rng.normal(0, 0.25, (120, 4)) + np.array([[0, 0, 0, 0], [3, 3, 0, 0], [0, 0, 3, 3]])[true]
    points = spark.createDataFrame([(k, p.tolist(), int(t)) for k, (p, t) in enumerate(zip(x, true))], "id long, features array<double>, true int").repartition(2).cache()
    return points, true, x


def follows(loss, start, *given):
    """Derivatives equal differences in one entry of each parameter."""
    rng = np.random.default_rng(5)
    value = lambda p: float(loss({k: Tensor(v) for k, v in p.items()}).data)
    p = {k: Tensor(v) for k, v in start.items()}
    loss(p).backward()
    for name, v in start.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        step = np.zeros_like(v)
        step[at] = 1e-6
        slope = (value({**start, name: v + step}) - value({**start, name: v - step})) / 2e-6
        assert p[name].grad[at] == pytest.approx(slope, rel=1e-3, abs=1e-6), name


def test_losses_follow_differences():
    rng = np.random.default_rng(2)
    net = Autoencoder.create((4, 3, 2), 1)
    x, near = rng.normal(size=(30, 4)), rng.normal(size=(30, 8))
    own = np.repeat([0.0, 1, 2], 10)[:, None]
    start = {**net.parameters, "axes": rng.normal(size=(3, 2))}
    follows(lambda p: dip_loss(net, [(0, 1), (0, 2), (1, 2)], 0.1)(x, p, rng, own), start)
    follows(lambda p: den_loss(net, 2, 2, heat=3.0)(x, p, rng, near), net.parameters)
    more = {f"n{j}_{k}": v for j in range(2) for k, v in Autoencoder.create((4, 3, 2), 7 + j).parameters.items() if k[0] == "d"}
    follows(lambda p: neighbour_loss(net, 2, True)(x, p, rng, near), {**net.parameters, **more})
    for values in (rng.normal(size=40), np.concatenate([rng.normal(-4, 1, 20), rng.normal(4, 1, 25)]), np.ones(9), rng.normal(size=3)):
        assert float(dip_tensor(Tensor(values)).data) == pytest.approx(dip_test(values).value)


def test_thresholds_stand_between_modes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(12, 1, 100)])
    rows = spark.createDataFrame([([float(v)], int(k >= 200)) for k, v in enumerate(x)], "features array<double>, own int").repartition(3)
    (t, all_to_one), (below, _) = pair_thresholds(rows, "own", np.array([[1.0], [1.0]]), [(0, 1), (0, 7)])
    assert 3 < t < 9 and below and all_to_one == np.inf
    (t,), (below,) = pair_thresholds(rows, "own", np.array([[-1.0]]), [(0, 1)])
    assert -9 < t < -3 and not below


def test_dip_encoder_parts_blobs(blobs):
    points, true, _ = blobs
    options = {"layers": (4, 6, 2), "pretrain_epochs": 25, "epochs": 2, "batch": 64, "rate": 1e-2}
    model = dip_encoder(points, 3, **options)
    assert agreement(true, labels(model.predict(points))) > 0.95 and len(model.losses) == 2
    known = dip_encoder(points, 3, label="true", **options)
    assert (np.array(labels(known.predict(points))) == true).mean() > 0.95


def test_rows_carry_their_neighbours(spark, blobs):
    points, true, x = blobs
    rows = {r["id"]: np.array(r["neighbours"]).reshape(3, 4) for r in with_neighbours(points, 3).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.where(np.eye(120, dtype=bool), np.inf, 0)
    for k in (0, 50, 119):
        assert np.allclose(rows[k], x[np.argsort(d[k], kind="stable")[:3]])
    alone = spark.createDataFrame([(1, [1.0, 2.0])], "id long, features array<double>")
    assert with_neighbours(alone, 2).first()["neighbours"] == [1.0, 2.0, 1.0, 2.0]
    model = den(points, 3, (4, 6, 2), neighbours=3, locality=0.5, sparsity=0.01, epochs=12, batch=32, rate=1e-2)
    assert model.losses[-1] < model.losses[0] and agreement(true, labels(model.predict(points))) > 0.9
    net, more, losses = neighbour_encoder(points, (4, 6, 2), 2, True, epochs=8, batch=32, rate=1e-2)
    assert losses[-1] < losses[0] and set(more) == {f"n{j}_d{x}{k}" for j in range(2) for x in "wb" for k in range(2)}


def test_two_planted_clusterings(spark):
    rng = np.random.default_rng(4)
    one, two = rng.integers(0, 3, 150), rng.integers(0, 2, 150)
    z = np.concatenate([np.array([[0, 0], [6, 0], [0, 6]])[one], np.array([[0, 0], [5, 5]])[two]], axis=1) + rng.normal(0, 0.3, (150, 4))
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(z @ turn)], "id long, features array<double>").repartition(2).cache()
    identity = Autoencoder((4, 4), {"ew0": np.eye(4), "eb0": np.zeros((1, 4)), "dw0": np.eye(4), "db0": np.zeros((1, 4))})
    model = enrc(points, (2, 3), (4, 4), epochs=2, batch=50, rate=1e-3, seed=4, net=identity, start_repeats=2)
    found = np.array([r["clusters"] for r in model.predict_spaces(points).orderBy("id").collect()])
    assert model.sizes == (3, 2) and agreement(found[:, 0], one) > 0.95 and agreement(found[:, 1], two) > 0.95
    # costs from loops
    start = enrc_start(points, (3, 2), "random", seed=1)
    w = np.array([[0.5, 1, 1, 0.2], [1, 0.1, 0.3, 1]])
    y = z @ turn @ start["turn"]
    costs = space_costs(points, start["turn"], [start["c0"], start["c1"]], w)
    for s in range(2):
        c = start[f"c{s}"]
        at = (((y[:, None] - c) ** 2) * w[s]).sum(2).argmin(1)
        for k in range(len(c)):
            assert costs[s][k, 0] == (at == k).sum() and np.allclose(costs[s][k, 1:], ((y[at == k] - c[k]) ** 2).sum(0))


def test_lost_centres_take_from_the_most_costly():
    centres = np.array([[0.0, 0], [9, 9], [5, 5]])
    costs = np.array([[10, 40.0, 10], [0, 0, 0], [10, 1, 1]])
    got = lost_centres_remade(centres, costs, np.ones(2))
    assert np.allclose(got, [[-2, 0], [2, 0], [5, 5]])
    assert np.allclose(lost_centres_remade(centres, np.zeros((3, 3)), np.ones(2)), centres)
