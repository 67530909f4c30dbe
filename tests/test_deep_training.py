"""Early stopping, saved state and layerwise training."""

import numpy as np
import pytest

from quillon.deep.autograd import Tensor
from quillon.deep.networks import Autoencoder, pretrain, reconstruction
from quillon.deep.training import EarlyStopping, hash_split, load, mean_loss, save, stacked, train


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2)) @ rng.normal(size=(2, 5)) + rng.normal(0, 0.05, (120, 5))
    return spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, features array<double>").repartition(2).cache()


def test_stopping_waits():
    s = EarlyStopping(patience=2, least=0.1)
    assert [s.better(v) for v in (5, 4, 3.95, 3.5, 3.6)] == [True, True, False, True, False] and not s.stop
    assert not s.better(3.45) and s.stop and s.best == 3.5


def test_split_and_loss(points):
    own, held = hash_split(points, 0.3)
    a, b = ({r["id"] for r in x.collect()} for x in (own, held))
    assert a.isdisjoint(b) and len(a | b) == 120 and 15 < len(b) < 60
    net = Autoencoder.create((5, 2), 1)
    x = np.array([r["features"] for r in points.collect()])
    want = float(reconstruction(net)(x, {k: Tensor(v) for k, v in net.parameters.items()}, None).data)
    assert mean_loss(points, net.parameters, reconstruction(net)) == pytest.approx(want)
    with pytest.raises(ValueError):
        mean_loss(points.limit(0), net.parameters, reconstruction(net))


def test_best_parameters_are_kept_and_resumed(spark, points, tmp_path):
    net, folder = Autoencoder.create((5, 2), 1), f"file://{tmp_path}/state"
    assert load(spark, folder) is None
    first = train(points, net, epochs=4, folder=folder, batch=32, rate=2e-2)
    p, state = load(spark, folder)
    assert state["epoch"] == first.best_epoch and state["loss"] == pytest.approx(min(first.validation))
    assert all(np.array_equal(p[k], v) for k, v in first.net.parameters.items())
    (tmp_path / "state" / "epoch=000099").mkdir()  # of a job that was lost while it wrote
    more = train(points, net, epochs=7, folder=folder, batch=32, rate=2e-2)
    assert more.resumed_at == first.best_epoch + 1 and more.best_epoch >= first.best_epoch and min(more.validation) < min(first.validation)
    rest = train(points, more.net, epochs=9, stopping=EarlyStopping(1, 1e9), batch=32)
    assert len(rest.losses) == 2 and rest.best_epoch == 0
    save(spark, {"a": np.zeros((2, 3))}, f"file://{tmp_path}/other", {"epoch": 3})
    assert load(spark, f"file://{tmp_path}/other")[0]["a"].shape == (2, 3)


def test_layers_are_trained_in_turn(points):
    net, losses = stacked(points, (5, 4, 2), layer_epochs=6, epochs=4, corrupt=0.1, batch=32, rate=2e-2)
    assert [len(x) for x in losses] == [6, 6, 4] and all(x[-1] < x[0] for x in losses)
    plain, start = pretrain(points, (5, 4, 2), 1, 32, 2e-2)
    assert losses[-1][0] < start[0] and set(net.parameters) == set(plain.parameters)
