"""Training with neighbours: DEN and the neighbour encoder.

Each row carries the features of its nearest neighbours, joined once over the
neighbour table, so batches need nothing from elsewhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.deep.autograd import Tensor
from quillon.deep.clustering import DeepModel, _reconstruction
from quillon.deep.networks import Autoencoder, epoch
from quillon.operators import geometry as geo
from quillon.operators.lineage import cut
from quillon.operators.partition import kmeans


def with_neighbours(points: DataFrame, k: int, name: str = "neighbours") -> DataFrame:
    """(id, features, neighbours): the features of the k nearest others one after the other, nearest first.

    Points with fewer others repeat their last; a point alone repeats itself.
    """
    own = points.select("id", F.col("features").cast("array<double>").alias("features"))
    near = geo.nearest(own, k).select(F.col("i"), F.col("j"), "rank")
    there = near.join(own.select(F.col("id").alias("j"), F.col("features").alias("f")), "j")
    lists = there.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "f"))).alias("l"))  # k entries a point
    held = own.join(lists, "id", "left").withColumn("l", F.coalesce(F.col("l.f"), F.array("features")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at("l", F.least(i + 1, F.size("l"))))
    return cut(held.select("id", "features", F.flatten(filled).alias(name)))


def group_sparsity(z: Tensor, groups: int, weights: np.ndarray | None = None) -> Tensor:
    """Mean over points of the sum of the lengths of consecutive groups of embedded dimensions, weighted by the root of a group's size if no weights are given."""
    total, parts = None, np.array_split(np.arange(z.shape[1]), groups)
    for g, part in enumerate(parts):
        own = z[:, part[0] : part[-1] + 1]
        length = ((own * own).sum(1) + 1e-12) ** 0.5
        length = length.mean() * (float(np.sqrt(len(part))) if weights is None else float(weights[g]))
        total = length if total is None else total + length
    return total


def den_loss(net: Autoencoder, k: int, groups: int, locality: float = 2.0, sparsity: float = 1.0, heat: float | None = None, reconstruct: float = 1.0):
    """Reconstruction, squared embedded distances to the neighbours (weighted by exp(-d2 / heat) where given), and group sparsity."""

    def loss(x, p, rng, near):
        n, d = x.shape
        z = net.encode(Tensor(x), p)
        others = net.encode(Tensor(near.reshape(n * k, d)), p)
        diff = z[np.repeat(np.arange(n), k)] - others
        apart = (diff * diff).sum(1)
        if heat is not None:
            apart = apart * np.exp(-((np.repeat(x, k, 0) - near.reshape(n * k, d)) ** 2).sum(1) / heat)
        return _reconstruction(net, x, z, p) * reconstruct + apart.mean() * locality + group_sparsity(z, groups) * sparsity

    return loss


def den(points: DataFrame, k: int, layers, neighbours: int = 5, groups: int | None = None, locality: float = 2.0, sparsity: float = 1.0, heat: float | None = None, epochs: int = 150, batch: int = 256, rate: float = 1e-3, seed: int = 0) -> DeepModel:
    """k-means in an embedding that keeps neighbours together and uses few groups of dimensions for each point; as many groups as clusters by default."""
    rows = with_neighbours(points, neighbours)
    net = Autoencoder.create(layers, seed)
    loss = den_loss(net, neighbours, min(groups or k, layers[-1]), locality, sparsity, heat)
    p, losses = net.parameters, []
    for e in range(epochs):
        p, value = epoch(rows, p, loss, batch, rate, seed + e, extra="neighbours")
        losses.append(value)
    net = net.with_parameters(p)
    return DeepModel(net, kmeans(net.transform(points), k, seed).centres, tuple(losses))


def neighbour_loss(net: Autoencoder, k: int, decode_self: bool = False):
    """Mean squared error of decoding each neighbour from the point's embedding by a decoder of its own, the point too if wanted.

    The parameters of neighbour j's decoder are those of the network's decoder with ``nj_`` in front.
    """

    def loss(x, p, rng, near):
        n, d = x.shape
        z = net.encode(Tensor(x), p)
        total = _reconstruction(net, x, z, p) if decode_self else Tensor(0.0)
        for j in range(k):
            own = {name: p[f"n{j}_{name}"] for name in net.parameters if name.startswith("d")}
            diff = net.decode(z, own) - near.reshape(n, k, d)[:, j]
            total = total + (diff * diff).sum(1).mean()
        return total * (1 / (k + decode_self))

    return loss


def neighbour_encoder(points: DataFrame, layers, neighbours: int = 5, decode_self: bool = False, epochs: int = 100, batch: int = 256, rate: float = 1e-3, seed: int = 0) -> tuple[Autoencoder, dict[str, np.ndarray], list[float]]:
    """A network trained to decode a point's neighbours, the parameters of their decoders, and the losses."""
    rows = with_neighbours(points, neighbours)
    net = Autoencoder.create(layers, seed)
    p = dict(net.parameters)
    for j in range(neighbours):
        p |= {f"n{j}_{name}": v for name, v in Autoencoder.create(layers, seed + 1 + j).parameters.items() if name.startswith("d")}
    losses = []
    for e in range(epochs):
        p, value = epoch(rows, p, neighbour_loss(net, neighbours, decode_self), batch, rate, seed + e, extra="neighbours")
        losses.append(value)
    return net.with_parameters(p), {k: v for k, v in p.items() if k not in net.parameters}, losses
