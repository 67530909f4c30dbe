"""DipEncoder: an embedding in which each pair of clusters has an axis that parts them.

Along its axis a pair should be as multimodal, and each of the two as unimodal, as
can be, by the dip.  The dip of a batch is differentiated through the three points
that set it.  Labels follow thresholds between the modal intervals, which come
from histograms of all points, added up over tasks.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.deep.autograd import Tensor
from quillon.deep.clustering import _reconstruction
from quillon.deep.dipdeck import histogram_dip, pair_histograms
from quillon.deep.networks import Autoencoder, epoch, pretrain
from quillon.functions.dip import dip_test
from quillon.operators.partition import kmeans


def dip_tensor(values: Tensor) -> Tensor:
    """Dip of n numbers, with its derivative in the three that set it; without one where none do or the outer two are equal."""
    order = np.argsort(values.data, kind="stable")
    found = dip_test(values.data[order], True)
    i, j, k = found.triangle
    if min(i, j) < 0 or values.data[order[k]] == values.data[order[i]]:
        return Tensor(found.value)
    a, b, c = (values[int(order[t])] for t in (i, j, k))
    height = (b - a) / (c - a) * float(k - i) + float(i - j)
    part = height * ((-1.0 if height.data < 0 else 1.0) / (2 * len(order)))
    return part + (found.value - float(part.data))


def _like_sized(z: np.ndarray, own: np.ndarray, other: np.ndarray, factor: float) -> np.ndarray:
    """Rows of a cluster, not more than ``factor`` times those of the other: its nearest to the other's mean."""
    most = max(4, int(factor * len(other)))
    if len(own) <= most:
        return own
    return own[np.argsort(np.abs(z[own] - z[other].mean()), kind="stable")[:most]]


def dip_loss(net: Autoencoder, pairs: list[tuple[int, int]], reconstruct: float = 1.0, factor: float = 3.0):
    """Over the pairs of which a batch has four points each: mean dip of the two clusters less that of both, averaged; and the reconstruction."""

    def loss(x, p, rng, labels):
        z = net.encode(Tensor(x), p)
        at, total, used = labels[:, 0].astype(int), Tensor(0.0), 0
        for q, (a, b) in enumerate(pairs):
            first, second = np.flatnonzero(at == a), np.flatnonzero(at == b)
            if min(len(first), len(second)) < 4:
                continue
            line = (z @ p["axes"][q : q + 1].T).reshape(-1)
            one, two = _like_sized(line.data, first, second, factor), _like_sized(line.data, second, first, factor)
            both = dip_tensor(line[np.concatenate([one, two])])
            total = total + (dip_tensor(line[first]) + dip_tensor(line[second])) * 0.5 - both
            used += 1
        out = _reconstruction(net, x, z, p) * reconstruct
        return out + total * (1 / used) if used else out

    return loss


@dataclass(frozen=True)
class DipEncoder:
    net: Autoencoder
    pairs: tuple[tuple[int, int], ...]
    axes: np.ndarray
    #: Threshold of each pair, and whether its first cluster is below.
    thresholds: np.ndarray
    first_below: np.ndarray
    k: int
    losses: tuple[float, ...] = ()

    def labels(self, z: np.ndarray) -> np.ndarray:
        """Clusters of embedded points: of most votes of the thresholds, of equal ones the smallest."""
        votes = np.zeros((len(z), self.k), int)
        below = (z @ self.axes.T < self.thresholds) == self.first_below
        for q, (a, b) in enumerate(self.pairs):
            votes[:, a] += below[:, q]
            votes[:, b] += ~below[:, q]
        return votes.argmax(1)

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        @F.pandas_udf("int")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(self.labels(self.net.embed(np.stack(features))) if len(features) else [], dtype="int32")

        return points.withColumn(name, run("features"))


def pair_thresholds(embedded: DataFrame, label: str, axes: np.ndarray, pairs, bins: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the middle between the facing ends of its clusters' modal intervals, and whether the first is below.

    A pair one of which has no points gives all to the other.
    """
    rows = embedded.select(F.concat(F.col("features").cast("array<double>"), F.array(F.col(label).cast("double"))).alias("features"))
    span, counts = pair_histograms(rows, axes, list(pairs), lambda x: (x[:, :-1], x[:, -1].astype(int)), bins)
    thresholds, below = np.zeros(len(pairs)), np.ones(len(pairs), bool)
    for q, (low, high) in enumerate(span):
        middles = low + (np.arange(bins) + 0.5) / bins * (high - low)
        sizes = counts[q].sum(1)
        if not sizes.all():
            thresholds[q] = np.inf if sizes[0] else -np.inf
            continue
        means = counts[q] @ middles / sizes
        below[q] = means[0] <= means[1]
        lower, upper = counts[q] if below[q] else counts[q][::-1]
        thresholds[q] = (histogram_dip(lower, low, high)[2] + histogram_dip(upper, low, high)[1]) / 2
    return thresholds, below


def dip_encoder(points: DataFrame, k: int, layers, label: str | None = None, reconstruct: float = 1.0, pretrain_epochs: int = 100, epochs: int = 100, bins: int = 2048, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> DipEncoder:
    """``label``: a column of known clusters 0 .. k - 1; without it they start from k-means and follow the thresholds after each epoch."""
    if net is None:
        net, _ = pretrain(points, layers, pretrain_epochs, batch, rate, seed)
    pairs = list(itertools.combinations(range(k), 2))
    columns = [F.col("id"), F.col("features"), *([F.col(label).alias("_own")] if label else [])]
    rows = points.select(*columns)
    model = kmeans(net.transform(rows), k, seed)
    if label:
        means = net.transform(rows).groupBy("_own").agg(F.array(*[F.avg(F.col("features")[j]) for j in range(net.layers[-1])]).alias("m"))
        centres = np.zeros((k, net.layers[-1]))
        for r in means.collect():  # clusters
            centres[r["_own"]] = r["m"]
    else:
        centres = model.centres
    axes = np.array([centres[b] - centres[a] for a, b in pairs])
    owned = lambda net: net.transform(rows) if label else None
    first = owned(net) if label else model.predict(net.transform(rows), "_own")
    found = DipEncoder(net, tuple(pairs), axes, *pair_thresholds(first, "_own", axes, pairs, bins), k)
    losses = []
    for e in range(epochs):
        if label:
            labelled = rows
        elif e:
            labelled = found.predict(rows, "_own")
        else:
            labelled = rows.join(first.select("id", "_own"), "id")
        labelled = labelled.withColumn("_own", F.array(F.col("_own").cast("double")))
        p, value = epoch(labelled, {**net.parameters, "axes": axes}, dip_loss(net, pairs, reconstruct), batch, rate, seed + e, extra="_own")
        axes, losses = p["axes"], [*losses, value]
        net_after = net.with_parameters(p)
        # the labels that were trained, embedded anew
        again = net_after.transform(rows if label else labelled.withColumn("_own", F.col("_own")[0]))
        net = net_after
        found = DipEncoder(net, tuple(pairs), axes, *pair_thresholds(again, "_own", axes, pairs, bins), k, tuple(losses))
    return found
