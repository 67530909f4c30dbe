"""VaDE: a variational autoencoder whose prior is a mixture of Gaussians, one a cluster.

The network follows the gradient of the evidence bound on partitions, the prior
being fixed within an epoch; then the bound's maximum over the prior, given the
memberships, is its weighted moments, which one pass adds up over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.deep.autograd import Tensor
from quillon.deep.networks import Autoencoder, epoch, pretrain
from quillon.operators.mixture import mixture


@dataclass(frozen=True)
class Prior:
    """Diagonal Gaussians: weights (k,), means and variances (k, d)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_joint(self, z):
        """log of weight times density, of arrays or tensors (n, d)."""
        z, s = z if isinstance(z, Tensor) else Tensor(z), 1 / self.variances
        apart = (z * z) @ s.T - (z @ (self.means * s).T) * 2.0 + (self.means**2 * s).sum(1)
        return apart * -0.5 + (np.log(np.maximum(self.weights, 1e-300)) - 0.5 * np.log(2 * math.pi * self.variances).sum(1))

    def members(self, z: np.ndarray) -> np.ndarray:
        return self.log_joint(z).softmax().data

    def predict(self, points: DataFrame, name: str = "cluster", membership: str = "membership", embed=None) -> DataFrame:
        """Points with their likeliest component and its membership, ``embed`` first where given."""

        @F.pandas_udf("k int, p double")
        def run(features: pd.Series) -> pd.DataFrame:
            if not len(features):
                return pd.DataFrame({"k": pd.Series(dtype="int32"), "p": pd.Series(dtype=float)})
            z = np.stack(features)
            m = self.members(z if embed is None else embed(z))
            return pd.DataFrame({"k": m.argmax(1).astype("int32"), "p": m.max(1)})

        return points.withColumn("_found", run("features")).withColumns({name: F.col("_found.k"), membership: F.col("_found.p")}).drop("_found")


def evidence_loss(net: Autoencoder, prior: Prior, reconstruct: float = 1.0):
    """Negative evidence bound a point: squared error of the decoded draw, and the divergence of draw and membership from the prior."""

    def loss(x, p, rng):
        mean, log_var = net.moments(Tensor(x), p)
        z = mean + (log_var * 0.5).exp() * rng.normal(size=mean.shape)
        diff = net.decode(z, p) - x
        gamma = prior.log_joint(z).softmax()
        s = 1 / prior.variances
        apart = (mean * mean + log_var.exp()) @ s.T - (mean @ (prior.means * s).T) * 2.0 + (prior.means**2 * s).sum(1)
        to_components = (apart + np.log(prior.variances).sum(1)) * 0.5
        to_weights = gamma.log() - np.log(np.maximum(prior.weights, 1e-300))
        own = (log_var + 1.0).sum(1).mean() * 0.5
        return (diff * diff).sum(1).mean() * reconstruct + (gamma * (to_components + to_weights)).sum(1).mean() - own

    return loss


def updated_prior(points: DataFrame, net: Autoencoder, prior: Prior, least: float = 1e-3) -> Prior:
    """The prior of the largest bound given memberships of the mean embeddings; one aggregation of k (2 d + 1) numbers.

    A component without members stays as it was; variances are ``least`` at least.
    """
    k, d = prior.means.shape

    def add(batches):
        total = np.zeros((k, 1 + 2 * d))
        p = {name: Tensor(v) for name, v in net.parameters.items()}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                mean, log_var = (t.data for t in net.moments(Tensor(x), p))
                total += prior.members(mean).T @ np.concatenate([np.ones((len(x), 1)), mean, mean**2 + np.exp(log_var)], axis=1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(k), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    rows = points.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(add, "k int, sums array<double>")
    out = np.zeros((k, 1 + 2 * d))
    for r in rows.select("k", F.posexplode("sums").alias("pos", "x")).groupBy("k", "pos").agg(F.sum("x").alias("x")).collect():
        out[r["k"], r["pos"]] = r["x"]
    n = out[:, :1]
    held = n > 1e-9 * max(n.sum(), 1e-300)
    means = np.where(held, out[:, 1 : d + 1] / np.where(held, n, 1), prior.means)
    variances = np.where(held, out[:, d + 1 :] / np.where(held, n, 1) - means**2, prior.variances)
    return Prior(n[:, 0] / max(n.sum(), 1e-300), means, np.maximum(variances, least))


@dataclass(frozen=True)
class VaDE:
    net: Autoencoder
    prior: Prior
    losses: tuple[float, ...]

    def predict(self, points: DataFrame, name: str = "cluster", membership: str = "membership") -> DataFrame:
        return self.prior.predict(points, name, membership, self.net.embed)


def vade(points: DataFrame, k: int, layers, pretrain_epochs: int = 100, epochs: int = 150, variational_weight: float = 0.01, reconstruct: float = 1.0, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> VaDE:
    """Pretrained with a weak unit prior (``variational_weight``), started from a diagonal mixture of the embedding."""
    if net is None:
        net, _ = pretrain(points, layers, pretrain_epochs, batch, rate, seed, variational_weight)
    if not net.variational:
        raise ValueError("the network is not variational")
    start = mixture(net.transform(points), k, kind="diag", repeats=3, seed=seed)
    prior = Prior(start.weights, start.means, np.maximum(np.array([np.diag(c) for c in start.covariances]), 1e-3))
    losses = []
    for e in range(epochs):
        p, value = epoch(points, net.parameters, evidence_loss(net, prior, reconstruct), batch, rate, seed + e)
        net = net.with_parameters(p)
        prior = updated_prior(points, net, prior)
        losses.append(value)
    return VaDE(net, prior, tuple(losses))
