"""DeepECT: its tree against plain loops, its loss by differences, and blobs."""

import numpy as np
import pytest

from quillon.deep.autograd import Tensor
from quillon.deep.networks import Autoencoder, pretrain
from quillon.deep.tree import CentreTree, deep_ect, grown, tree_loss
from tests.test_deep import agreement, labels


def plain_split(x):
    """2-means from the mean, moved along the widest axis."""
    mean, axis = x.mean(0), x.var(0).argmax()
    step = np.zeros(x.shape[1])
    step[axis] = x[:, axis].std()
    pair = np.array([mean - step, mean + step])
    for _ in range(10):
        at = ((x[:, None] - pair) ** 2).sum(2).argmin(1)
        pair = np.array([x[at == k].mean(0) for k in range(2)])
    return ((x[:, None] - pair) ** 2).sum(2).argmin(1)


def test_flat_cuts_equal_plain_bisection(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.5, (n, 2)) for c, n in zip(([0, 0], [30, 0], [30, 6], [0, 11]), (40, 30, 20, 25))])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>").repartition(3)
    tree, parts, steps = CentreTree({0: np.zeros(2)}), [np.arange(len(x))], []
    for k in range(2, 5):
        tree = grown(points, tree)
        worst = max(range(len(parts)), key=lambda i: ((x[parts[i]] - x[parts[i]].mean(0)) ** 2).sum())
        own = parts.pop(worst)
        side = plain_split(x[own])
        parts += [own[side == 0], own[side == 1]]
        plain = np.zeros(len(x), int)
        for i, part in enumerate(parts):
            plain[part] = i
        steps.append(plain)
    leaf = ((x[:, None] - tree.leaf_centres()) ** 2).sum(2).argmin(1)
    for k, plain in zip(range(2, 5), steps):
        assert agreement(tree.flat(k)[leaf], plain) == 1
    assert (tree.flat(1) == 0).all()
    with pytest.raises(ValueError):
        tree.flat(5)


def test_leaves_are_cut_off():
    tree = CentreTree({0: np.zeros(1)}).split(0, np.array([[-1.0], [1.0]])).split(2, np.array([[0.5], [2.0]]))
    assert tree.leaves == [1, 3, 4] and tree.parents() == {1: 0, 2: 0, 3: 2, 4: 2}
    less = tree.without(3)
    assert less.leaves == [1, 2] and less.centres[2] == 2.0
    less = tree.without(1)
    assert less.leaves == [3, 4] and less.children == {0: (3, 4)}
    moved = tree.weighted(np.array([[0.0], [2.0], [5.0]]), np.array([1, 1, 2]))
    assert moved.centres[2] == 4.0 and moved.centres[0] == 3.0
    axes, at, below = tree.projections()
    assert axes.ravel().tolist() == [-1, 1, -1, 1] and at.tolist() == [1, 1, -0.5, 2] and below.tolist() == [[1, 0, 0, 0], [0, 1, 1, 0], [0, 1, 0, 1]]


def test_loss_follows_differences():
    rng = np.random.default_rng(1)
    net = Autoencoder.create((4, 3, 2), 1)
    tree = CentreTree({0: np.zeros(2)}).split(0, rng.normal(size=(2, 2))).split(1, rng.normal(size=(2, 2)))
    x = rng.normal(size=(9, 4))
    start = {**net.parameters, "leaves": tree.leaf_centres()}
    loss = tree_loss(net, tree, 0.5)
    held = net.encode(Tensor(x), {k: Tensor(v) for k, v in start.items()}).data  # the means that leaves follow are constants

    def plain(p):
        z = net.encode(Tensor(x), {k: Tensor(v) for k, v in p.items()}).data
        out = 0.5 * ((net.decode(Tensor(z), {k: Tensor(v) for k, v in p.items()}).data - x) ** 2).sum(1).mean()
        own = ((held[:, None] - start["leaves"]) ** 2).sum(2).argmin(1)
        for i, leaf in enumerate(tree.leaves):
            node, up = leaf, tree.parents()
            while node in up:
                sibling = next(c for c in tree.children[up[node]] if c != node)
                axis = (tree.centres[node] - tree.centres[sibling]) / np.linalg.norm(tree.centres[node] - tree.centres[sibling])
                out += np.abs((z[own == i] - tree.centres[node]) @ axis).sum() / (len(x) * 3)
                node = up[node]
            if (own == i).any():
                out += ((p["leaves"][i] - held[own == i].mean(0)) ** 2).sum() / 3
        return out

    p = {k: Tensor(v) for k, v in start.items()}
    value = loss(x, p, rng)
    value.backward()
    assert float(value.data) == pytest.approx(plain(start))
    for name, v in start.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        step = np.zeros_like(v)
        step[at] = 1e-6
        slope = (plain({**start, name: v + step}) - plain({**start, name: v - step})) / 2e-6
        assert p[name].grad[at] == pytest.approx(slope, rel=1e-4, abs=1e-6), name


def test_finds_blobs(spark):
    rng = np.random.default_rng(0)
    true = np.repeat(np.arange(3), 50)
    x = rng.normal(0, 0.25, (150, 5)) + np.array([[0, 0, 0, 0, 0], [3, 3, 0, 0, 0], [0, 0, 3, 3, 0]])[true]
    points = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, features array<double>").repartition(2).cache()
    net, _ = pretrain(points, (5, 8, 2), 40, 32, 1e-2)
    model = deep_ect(points, (5, 8, 2), most_leaves=5, grow_every=1, epochs=4, batch=32, net=net)
    assert len(model.tree.leaves) == 5 and len(model.losses) == 4
    assert agreement(true, labels(model.predict(points, 3))) > 0.9
