"""Augmented rows, and training on pairs of rows and augmented rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.deep.augment import Affine, Noise, changes, draws, with_augmented
from quillon.deep.autograd import Tensor
from quillon.deep.clustering import acedec, dcn, dcn_loss, dec, dec_loss
from quillon.deep.networks import Autoencoder, pretrain, reconstruction


@pytest.fixture(scope="module")
def images(spark):
    """Bars that stand or lie in 6 x 6 images."""
    rng, rows = np.random.default_rng(0), []
    for k in range(80):
        x = np.zeros((6, 6))
        x[(slice(None), 2 + k % 4 // 2) if k % 2 else (2 + k % 4 // 2, slice(None))] = 1
        rows.append((k, (x + rng.normal(0, 0.02, (6, 6))).ravel().tolist(), k % 2))
    return spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(3).cache()


def test_draws_are_those_of_plain_md5(spark):
    got = spark.range(3).select("id", draws(F.col("id"), 7, 6).alias("u")).collect()
    for r in got:
        want = [int(hashlib.md5(f"{r['id']}:7:{k // 4}".encode()).hexdigest()[k % 4 * 8 : k % 4 * 8 + 8], 16) / 2**32 for k in range(6)]
        assert r["u"] == want


def test_draws_stay_with_rows(images):
    augment = Noise(36, 0.1, 0.3)
    one = {r["id"]: r["augmented"] for r in with_augmented(images, augment, 1).collect()}
    again = {r["id"]: r["augmented"] for r in with_augmented(images.repartition(7), augment, 1).collect()}
    later = {r["id"]: r["augmented"] for r in with_augmented(images, augment, 2).collect()}
    assert one == again and all(one[k] != later[k] for k in one)
    values = np.array(list(one.values()))
    assert 0.25 < (values == 0).mean() < 0.35
    apart = values - np.array([r["features"] for r in sorted(images.collect(), key=lambda r: list(one).index(r["id"]))])
    assert 0.09 < apart[values != 0].std() < 0.11
    assert with_augmented(images.limit(0), augment).count() == 0


def plain_affine(a, x, u):
    """One pixel at a time."""
    c, h, w = a.shape
    t, slant = np.radians((2 * u[0] - 1) * a.degrees), np.radians((2 * u[3] - 1) * a.shear)
    planes, out = x.reshape(c, h, w), np.zeros((c, h, w))
    back = np.array([[1, 0], [-np.tan(slant), 1]]) @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    for i in range(h):
        for j in range(w):
            y, z = back @ (i - (h - 1) / 2 - (2 * u[1] - 1) * a.shift * h, j - (w - 1) / 2 - (2 * u[2] - 1) * a.shift * w) + ((h - 1) / 2, (w - 1) / 2)
            for q in range(c):
                total = 0.0
                for m in range(int(np.floor(y)), int(np.floor(y)) + 2):
                    for n in range(int(np.floor(z)), int(np.floor(z)) + 2):
                        share = (1 - abs(y - m)) * (1 - abs(z - n))
                        total += share * (planes[q, m, n] if 0 <= m < h and 0 <= n < w else a.fill)
                out[q, i, j] = total
    return out.ravel()


def test_affine_equals_a_plain_one():
    rng = np.random.default_rng(3)
    a = Affine((2, 5, 4), 30.0, 0.3, 12.0, 0.5)
    x, u = rng.normal(size=(6, 40)), rng.random((6, 4))
    assert np.allclose(a(x, u), [plain_affine(a, v, w) for v, w in zip(x, u)])
    assert np.allclose(a(x, np.full((6, 4), 0.5)), x)  # nothing is moved
    moved = Affine((1, 4, 4), 0.0, 0.25, 0.0)(np.eye(4).reshape(1, 16), np.array([[0.5, 1.0, 0.5, 0.5]]))
    assert np.allclose(moved.reshape(4, 4), np.eye(4, k=-1))  # one line down


@pytest.mark.parametrize("kind", ["reconstruction", "dec", "dcn"])
def test_paired_losses_and_gradients(kind):
    rng = np.random.default_rng(1)
    net = Autoencoder.create((5, 4, 2), 2)
    values = dict(net.parameters) | {"centres": rng.normal(size=(3, 2))}
    loss = {"reconstruction": reconstruction(net), "dec": dec_loss(net, 1.0, 0.5), "dcn": dcn_loss(net, 0.3, 1.0)}[kind]
    x, other = rng.normal(size=(7, 5)), rng.normal(size=(7, 5))
    p = {k: Tensor(v) for k, v in values.items()}
    out = loss(x, p, None, other)
    # a row beside itself is as if it were alone
    assert float(loss(x, p, None, x).data) == pytest.approx(float(loss(x, p, None).data))
    out.backward()
    if kind == "dec":  # its target is fixed within a step, so differences of the whole loss say something else
        z, w = (net.encode(Tensor(v), p).data for v in (x, other))
        q, r = (1 / (1 + ((v[:, None] - values["centres"]) ** 2).sum(2)) for v in (z, w))
        q, r = q / q.sum(1, keepdims=True), r / r.sum(1, keepdims=True)
        t = q**2 / q.sum(0)
        t /= t.sum(1, keepdims=True)
        rec = [((net.decode(Tensor(e), p).data - v) ** 2).sum(1).mean() * 0.5 for e, v in ((z, x), (w, other))]
        want = (-(t * np.log(q)).sum(1).mean() - (t * np.log(r)).sum(1).mean() + sum(rec)) / 2
        assert float(out.data) == pytest.approx(want)
        return
    for name in ("ew0", "dw1"):
        for at in [(0, 0), (1, 1)]:
            ends = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in values.items()}
                moved[name][at] += step
                ends.append(float(loss(x, {k: Tensor(v) for k, v in moved.items()}, None, other).data))
            assert p[name].grad[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_training_on_pairs(images):
    augment = Affine((1, 6, 6), 10.0, 0.1, 5.0)
    assert changes(images, augment) and not changes(images, Affine((1, 6, 6), 0.0, 0.0, 0.0))
    net, losses = pretrain(images, (36, 16, 2), 6, 16, 1e-2, 0, augment=augment)
    assert losses[-1] < losses[0]
    again, _ = pretrain(images, (36, 16, 2), 6, 16, 1e-2, 0, augment=augment)
    assert all(np.allclose(net.parameters[k], again.parameters[k]) for k in net.parameters)
    for method in (dec, dcn, acedec):
        model = method(images, 2, None, epochs=2, batch=16, net=net, augment=augment)
        assert len(model.losses) == 2 and np.isfinite(model.losses).all() and model.centres.shape[1] == 2
    with pytest.raises(ValueError):
        dec(images, 2, None, net=net, augment=Affine((1, 6, 6), 0.0, 0.0, 0.0))
    with pytest.raises(ValueError):
        pretrain(images, (36, 2), variational_weight=1.0, augment=augment)


def test_augmented_other_size_is_refused(images):
    class Cut:
        numbers = 1

        def __call__(self, x, u):
            return x[:, 1:]

    with pytest.raises(Exception, match="another size"):
        with_augmented(images, Cut()).collect()
