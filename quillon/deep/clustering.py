"""Clustering in learned embeddings.

All methods start from an autoencoder and from k-means in its embedding, and
train network and centres together by a loss of their own; see
:mod:`quillon.deep.networks` for how partitions train.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.deep.augment import changes
from quillon.deep.autograd import Tensor, squared_distances
from quillon.deep.networks import Autoencoder, epoch, paired_epoch, pretrain
from quillon.operators import density
from quillon.operators.dctree import dc_tree
from quillon.operators.mixture import Mixture, mixture
from quillon.operators.partition import _nearest, kmeans
from quillon.operators.subspace import best_nr_kmeans


@dataclass(frozen=True)
class DeepModel:
    net: Autoencoder
    centres: np.ndarray
    losses: tuple[float, ...] = ()
    #: Weights of the subspaces in each embedded dimension, where there are several: rows are subspaces.
    weights: np.ndarray | None = None
    #: Rotation in front of the weights, and clusters of each subspace.
    turn: np.ndarray | None = None
    sizes: tuple[int, ...] = ()

    def space_labels(self, x: np.ndarray) -> np.ndarray:
        """(points, subspaces): the nearest centre of each subspace under its weights."""
        y, out, at = self.net.embed(x) @ self.turn, [], 0
        for w, k in zip(self.weights, self.sizes):
            root = np.sqrt(w)
            out.append(_nearest(y * root, self.centres[at : at + k] @ self.turn * root))
            at += k
        return np.stack(out, axis=1)

    def predict_spaces(self, points: DataFrame, name: str = "clusters") -> DataFrame:
        """Points with the array of their labels in all subspaces."""

        @F.pandas_udf("array<int>")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(list(self.space_labels(np.stack(features)).astype("int32")) if len(features) else [], dtype=object)

        return points.withColumn(name, run("features"))

    def transform(self, points: DataFrame) -> DataFrame:
        return self.net.transform(points)

    def labels(self, x: np.ndarray) -> np.ndarray:
        return _nearest(self.net.embed(x), self.centres)

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        @F.pandas_udf("int")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(self.labels(np.stack(features)) if len(features) else [], dtype="int32")

        return points.withColumn(name, run("features"))


def soft_assignment(d2: Tensor, alpha: float = 1.0) -> Tensor:
    """Student-t memberships from squared distances."""
    q = (d2 * (1 / alpha) + 1.0) ** (-(alpha + 1) / 2)
    return q / q.sum(1, keepdims=True)


def target_distribution(q: np.ndarray) -> np.ndarray:
    """Memberships sharpened: squares over cluster sizes."""
    w = q**2 / np.maximum(q.sum(0), 1e-300)
    return w / np.maximum(w.sum(1, keepdims=True), 1e-300)


def cross_entropy(q: Tensor, p: np.ndarray) -> Tensor:
    return -(q.log() * p).sum(1).mean()


def _reconstruction(net: Autoencoder, x: np.ndarray, z: Tensor, p) -> Tensor:
    diff = net.decode(z, p) - x
    return (diff * diff).sum(1).mean()


def _joint(points: DataFrame, net: Autoencoder, more: dict[str, np.ndarray], loss: Callable, epochs: int, batch: int, rate: float, seed: int, after: Callable | None = None, augment: Callable | None = None) -> tuple[Autoencoder, dict[str, np.ndarray], list[float]]:
    """Train network and further parameters together; ``after(parameters)`` may change the latter between epochs.

    With ``augment`` the loss takes augmented rows, drawn anew for each epoch,
    beside the rows.
    """
    p, losses = {**net.parameters, **more}, []
    for e in range(epochs):
        p, value = paired_epoch(points, p, loss, batch, rate, seed + e, augment)
        losses.append(value)
        if after is not None:
            p = {**p, **after(p)}
    return net.with_parameters(p), {k: p[k] for k in more}, losses


def _start(points: DataFrame, k: int, layers, net: Autoencoder | None, epochs: int, batch: int, rate: float, seed: int, augment: Callable | None = None) -> tuple[Autoencoder, np.ndarray]:
    if augment is not None and not changes(points, augment, seed):
        raise ValueError("the augmentation changes no row")
    if net is None:
        net, _ = pretrain(points, layers, epochs, batch, rate, seed, augment=augment)
    return net, kmeans(net.transform(points), k, seed).centres


def dec_loss(net: Autoencoder, alpha: float = 1.0, reconstruct: float = 0.0):
    """Cross entropy of memberships and their sharpened version, which augmented rows, if any, share."""

    def loss(x, p, rng, other=None):
        want, parts = None, []
        for rows in (x,) if other is None else (x, other):
            z = net.encode(Tensor(rows), p)
            q = soft_assignment(squared_distances(z, p["centres"]), alpha)
            want = target_distribution(q.data) if want is None else want
            out = cross_entropy(q, want)
            parts.append(out + _reconstruction(net, rows, z, p) * reconstruct if reconstruct else out)
        return _mean(parts)

    return loss


def _mean(parts: list[Tensor]) -> Tensor:
    return parts[0] if len(parts) == 1 else (parts[0] + parts[1]) * 0.5


def dec(points: DataFrame, k: int, layers, alpha: float = 1.0, reconstruct: float = 0.0, pretrain_epochs: int = 100, epochs: int = 150, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None, augment: Callable | None = None) -> DeepModel:
    """Memberships drawn towards their own sharpened version; ``reconstruct`` > 0 keeps the reconstruction beside it (IDEC).

    ``augment``: see :mod:`quillon.deep.augment`; memberships of augmented rows are
    drawn towards those of the rows they come from, half the loss is theirs.
    """
    net, centres = _start(points, k, layers, net, pretrain_epochs, batch, rate, seed, augment)
    loss = dec_loss(net, alpha, reconstruct)
    net, more, losses = _joint(points, net, {"centres": centres}, loss, epochs, batch, rate, seed, augment=augment)
    return DeepModel(net, more["centres"], tuple(losses))


def idec(points: DataFrame, k: int, layers, weight: float = 0.1, **options) -> DeepModel:
    """DEC with reconstruction; ``weight`` is that of the clustering loss."""
    return dec(points, k, layers, reconstruct=1 / weight, **options)


def _means(points: DataFrame, net: Autoencoder, p: dict, centres: np.ndarray) -> np.ndarray:
    """Means of the embedded points of each centre; one without points stays."""
    own = net.with_parameters(p)

    def add(frames):
        total = np.zeros((len(centres), 1 + centres.shape[1]))
        for frame in frames:
            if len(frame):
                z = own.embed(np.stack(frame["features"]).astype(float))
                np.add.at(total, _nearest(z, centres), np.concatenate([np.ones((len(z), 1)), z], axis=1))
        yield pd.DataFrame({"k": range(len(total)), "sums": list(total)})

    rows = points.select("features").mapInPandas(add, "k int, sums array<double>").select("k", F.posexplode("sums").alias("pos", "x")).groupBy("k", "pos").agg(F.sum("x").alias("x"))
    out = np.zeros((len(centres), 1 + centres.shape[1]))
    for r in rows.collect():  # model-sized
        out[r["k"], r["pos"]] = r["x"]
    return np.where(out[:, :1] > 0, out[:, 1:] / np.maximum(out[:, :1], 1), centres)


def dcn_loss(net: Autoencoder, weight: float, reconstruct: float):
    """Reconstruction, and squared distances to the nearest centre; augmented rows, if any, keep the centre of theirs."""

    def loss(x, p, rng, other=None):
        c, at, parts = p["centres"].data, None, []
        for rows in (x,) if other is None else (x, other):
            z = net.encode(Tensor(rows), p)
            at = _nearest(z.data, c) if at is None else at
            diff = z - c[at]
            parts.append(_reconstruction(net, rows, z, p) * reconstruct + (diff * diff).sum(1).mean() * (weight / 2))
        return _mean(parts)

    return loss


def dcn(points: DataFrame, k: int, layers, weight: float = 0.05, reconstruct: float = 1.0, pretrain_epochs: int = 100, epochs: int = 50, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None, augment: Callable | None = None) -> DeepModel:
    """Embeddings drawn to their nearest centre; centres move to the means of their points after each epoch.

    With ``augment`` augmented rows are drawn to the centre of the row they come
    from; the means are those of the points alone.
    """
    net, centres = _start(points, k, layers, net, pretrain_epochs, batch, rate, seed, augment)
    loss = dcn_loss(net, weight, reconstruct)

    net, more, losses = _joint(points, net, {"centres": centres}, loss, epochs, batch, rate, seed, lambda p: {"centres": _means(points, net, p, p["centres"])}, augment)
    return DeepModel(net, more["centres"], tuple(losses))


def aec(points: DataFrame, k: int, layers, weight: float = 0.1, **options) -> DeepModel:
    """The same loss with twice its weight (auto-encoder based clustering)."""
    return dcn(points, k, layers, 2 * weight, **options)


def default_alphas(n: int = 40, scale: float = 0.1) -> list[float]:
    """Rising steepness of the softmax: a_1 = scale, then times 2 to the power of 1 over the log of the square of the step."""
    out = [scale]
    for i in range(2, n + 1):
        out.append(out[-1] * 2 ** (1 / math.log(i) ** 2))
    return out


def dkm(points: DataFrame, k: int, layers, alphas=(1000.0,), weight: float = 1.0, reconstruct: float = 1.0, pretrain_epochs: int = 50, epochs: int = 100, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> DeepModel:
    """Distances to centres weighted by a softmax whose steepness runs through ``alphas``, some epochs each."""
    net, centres = _start(points, k, layers, net, pretrain_epochs, batch, rate, seed)
    every: list[float] = []
    for alpha in alphas:

        def loss(x, p, rng, alpha=alpha):
            z = net.encode(Tensor(x), p)
            d = squared_distances(z, p["centres"])
            near = d - d.data.min(1, keepdims=True)
            return _reconstruction(net, x, z, p) * reconstruct + ((near * -alpha).softmax() * d).sum(1).mean() * weight

        net, more, losses = _joint(points, net, {"centres": centres}, loss, epochs, batch, rate, seed + len(every))
        centres, every = more["centres"], every + losses
    return DeepModel(net, centres, tuple(every))


def acedec(points: DataFrame, k: int, layers, **options) -> DeepModel:
    """One clustered and one shared space, each with a k-means loss, among which learned weights deal the embedded dimensions."""
    return enrc(points, (k, 1), layers, **options)


def space_costs(embedded: DataFrame, turn: np.ndarray, centres: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
    """For each space (k, 1 + d): points of each cluster, and their squared residuals by rotated dimension; one pass.

    A point belongs to the centre that is nearest under the space's weights.
    """
    d, ends = len(turn), np.cumsum([0, *[len(c) for c in centres]])

    def add(frames):
        total = np.zeros((ends[-1], 1 + d))
        for frame in frames:
            if len(frame):
                y = np.stack(frame["features"]).astype(float) @ turn
                for s, c in enumerate(centres):
                    root = np.sqrt(weights[s])
                    at = _nearest(y * root, c * root)
                    np.add.at(total, ends[s] + at, np.concatenate([np.ones((len(y), 1)), (y - c[at]) ** 2], axis=1))
        used = np.flatnonzero(total[:, 0])
        if len(used):
            yield pd.DataFrame({"k": used, "sums": list(total[used])})

    out = np.zeros((ends[-1], 1 + d))
    rows = embedded.select("features").mapInPandas(add, "k int, sums array<double>").select("k", F.posexplode("sums").alias("pos", "x"))
    for r in rows.groupBy("k", "pos").agg(F.sum("x").alias("x")).collect():  # model-sized
        out[r["k"], r["pos"]] = r["x"]
    return [out[a:b] for a, b in zip(ends, ends[1:])]


def lost_centres_remade(centres: np.ndarray, costs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each centre without points takes half of the most costly cluster: both stand one deviation to either side of it, in its widest weighted dimension."""
    centres, costs = centres.copy(), costs.copy()
    for lost in np.flatnonzero(costs[:, 0] == 0):
        weighted = costs[:, 1:] * weights
        worst = int(weighted.sum(1).argmax())
        if costs[worst, 0] < 2 or weighted[worst].sum() == 0:
            break
        step = np.zeros(centres.shape[1])
        dim = int(weighted[worst].argmax())
        step[dim] = math.sqrt(costs[worst, 1 + dim] / costs[worst, 0])
        centres[lost], centres[worst] = centres[worst] + step, centres[worst] - step
        costs[worst] /= 2
        costs[lost] = costs[worst]
    return centres


def enrc_start(embedded: DataFrame, sizes, start: str = "nrkmeans", repeats: int = 10, seed: int = 0) -> dict[str, np.ndarray]:
    """Rotation, logits of the weights and rotated centres from NrKmeans of the embedding, or drawn at random.

    With NrKmeans the weight of a space in a dimension is in proportion to one
    over the mean squared residual there, which is least for the sum of squared
    weights times residuals.
    """
    d = embedded.select(F.max(F.size("features"))).first()[0]
    if start == "random":
        rng = np.random.default_rng(seed)
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        logits = np.where(rng.integers(0, len(sizes), d)[None] == np.arange(len(sizes))[:, None], 1.0, 0.0)
        return {"logits": logits, "turn": turn} | {f"c{s}": kmeans(embedded, k, seed + s).centres @ turn for s, k in enumerate(sizes)}
    if start != "nrkmeans":
        raise ValueError("start is nrkmeans or random")
    found = best_nr_kmeans(embedded, sizes, repeats, seed=seed)
    own = np.zeros((len(sizes), d))  # a space that lost all its dimensions starts from k-means
    for s, space in enumerate(found.spaces):
        own[s, list(space.columns)] = 1.0
    centres = [space.centres @ found.rotation for space in found.spaces]
    centres += [kmeans(embedded, k, seed + s).centres @ found.rotation for s, k in enumerate(sizes) if s >= len(found.spaces)]
    costs = space_costs(embedded, found.rotation, centres, np.maximum(own, 1e-9))
    mean = np.array([c[:, 1:].sum(0) / max(c[:, 0].sum(), 1) for c in costs])
    return {"logits": -np.log(np.maximum(mean, 1e-12)), "turn": found.rotation} | {f"c{s}": c for s, c in enumerate(centres)}


def enrc(points: DataFrame, n_clusters, layers, pretrain_epochs: int = 100, epochs: int = 100, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None, start: str = "nrkmeans", start_repeats: int = 10, reinit_every: int = 1, augment: Callable | None = None) -> DeepModel:
    """Several clusterings in weighted parts of one embedding; centres of all spaces, largest first, are stacked in ``centres``.

    ``start``, ``start_repeats``: see :func:`enrc_start`; one run of NrKmeans often
    ends in a local optimum.  After every ``reinit_every`` epochs centres
    without points are made anew from the most costly cluster of their space.
    With ``augment`` augmented rows keep the centres of the rows they come from.
    """
    if augment is not None and not changes(points, augment, seed):
        raise ValueError("the augmentation changes no row")
    if net is None:
        net, _ = pretrain(points, layers, pretrain_epochs, batch, rate, seed, augment=augment)
    sizes = sorted(n_clusters, reverse=True)
    first = enrc_start(net.transform(points), sizes, start, start_repeats, seed)
    d = len(first["turn"])

    def shares(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(0))
        return e / e.sum(0)

    def loss(x, p, rng, other=None):
        beta, at, parts = p["logits"].softmax(0), {}, []
        for rows in (x,) if other is None else (x, other):
            z = net.encode(Tensor(rows), p)
            y = z @ p["turn"]
            total = _reconstruction(net, rows, z, p)
            for s in range(len(sizes)):
                w = beta[s : s + 1]
                centres = p[f"c{s}"]
                if s not in at:
                    at[s] = _nearest(y.data * w.data**0.5, centres.data * w.data**0.5)
                diff = y - centres[at[s]]
                total = total + (diff * diff * w).sum(1).mean()
            parts.append(total)
        off = p["turn"] @ p["turn"].T - np.eye(d)
        return _mean(parts) + (off * off).sum()

    done = [0]

    def after(p):
        done[0] += 1
        if done[0] % reinit_every:
            return {}
        weights, centres = shares(p["logits"]), [p[f"c{s}"] for s in range(len(sizes))]
        costs = space_costs(net.with_parameters(p).transform(points), p["turn"], centres, weights)
        return {f"c{s}": lost_centres_remade(c, costs[s], weights[s]) for s, c in enumerate(centres)}

    net, more, losses = _joint(points, net, first, loss, epochs, batch, rate, seed, after, augment)
    return DeepModel(net, np.concatenate([more[f"c{s}"] for s in range(len(sizes))]) @ more["turn"].T, tuple(losses), shares(more["logits"]), more["turn"], tuple(len(more[f"c{s}"]) for s in range(len(sizes))))


def shade(points: DataFrame, k: int, layers, min_points: int = 5, reconstruct: float = 1.0, epochs: int = 100, batch: int = 64, rate: float = 1e-3, seed: int = 0) -> DeepModel:
    """Embedded distances fitted to density-connectivity distances; clusters from the embedding's own tree.

    The tree's distances of a batch are looked up from the positions of its
    points, so every task holds the tree (one merge a point) and never n x n
    distances.
    """
    tree = dc_tree(points, min_points)
    place = {x: i for i, x in enumerate(tree.ids)}
    shared = points.sparkSession.sparkContext.broadcast(tree.table_arrays())

    @F.pandas_udf("array<double>")
    def positions(ids: pd.Series) -> pd.Series:
        return pd.Series([[float(place[i])] for i in ids], dtype=object)

    rows = points.withColumn("place", positions("id"))
    net = Autoencoder.create(layers, seed)

    def loss(x, p, rng, at):
        z = net.encode(Tensor(x), p)
        out = _reconstruction(net, x, z, p) * reconstruct
        if len(x) <= min_points:
            return out
        i, j = np.triu_indices(len(x), 1)
        want = shared.value.distances(at[:, 0].astype(int)[i], at[:, 0].astype(int)[j])
        diff = z[i] - z[j]
        apart = ((diff * diff).sum(1) + 1e-12) ** 0.5 - want
        return out + (apart * apart).mean()

    p, losses = net.parameters, []
    for e in range(epochs):
        p, value = epoch(rows, p, loss, batch, rate, seed + e, extra="place")
        losses.append(value)
    net = net.with_parameters(p)
    return DeepModel(net, kmeans(net.transform(points), k, seed).centres, tuple(losses))


@dataclass(frozen=True)
class EmbeddedMixture:
    net: Autoencoder
    mixture: Mixture

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        found = self.mixture.predict(self.net.transform(points), name)
        return points.join(found.select("id", name), "id")


def embedded_mixture(points: DataFrame, k: int, layers, pretrain_epochs: int = 100, variational_weight: float | None = None, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> EmbeddedMixture:
    """A Gaussian mixture in the embedding of an autoencoder, or of a variational one."""
    if net is None:
        net, _ = pretrain(points, layers, pretrain_epochs, batch, rate, seed, variational_weight)
    return EmbeddedMixture(net, mixture(net.transform(points), k, repeats=3, seed=seed))


def embedded_density_peaks(points: DataFrame, layers, ratio: float = 0.1, pretrain_epochs: int = 100, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> tuple[DataFrame, int]:
    """(id, cluster) and their number: density peaks in the embedding of an autoencoder, with no k given."""
    if net is None:
        net, _ = pretrain(points, layers, pretrain_epochs, batch, rate, seed)
    return density.density_peak_clusters(net.transform(points), ratio)

