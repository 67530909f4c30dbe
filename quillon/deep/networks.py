"""Feedforward autoencoders and their training on partitions.

Parameters are a dict of arrays.  In an epoch every task starts from the same
parameters, takes steps of Adam on small batches of its own partition, and
returns what it ends with; the average, weighted by points, starts the next
epoch (local SGD with parameter averaging).  Vectors are added up by Spark in
pieces, so the driver receives one set of parameters an epoch, however many
tasks there are.  An epoch that is run again, after a lost executor, draws the
same batches.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.deep.augment import OTHER, with_augmented
from quillon.deep.autograd import Tensor

Parameters = dict[str, np.ndarray]
#: Numbers of a parameter vector that travel together.
PIECE = 1 << 14


@dataclass(frozen=True)
class Autoencoder:
    """Layers from the input to the embedding, mirrored for the way back; hidden layers are leaky rectifiers."""

    layers: tuple[int, ...]
    parameters: Parameters = field(repr=False, default_factory=dict)
    variational: bool = False

    @staticmethod
    def create(layers, seed: int = 0, variational: bool = False) -> Autoencoder:
        rng, out = np.random.default_rng(seed), {}
        sizes = tuple(layers)
        for side, own in (("e", sizes), ("d", sizes[::-1])):
            for k, (a, b) in enumerate(zip(own, own[1:])):
                wide = 2 * b if variational and side == "e" and k == len(own) - 2 else b
                out[f"{side}w{k}"] = rng.normal(0, math.sqrt(2 / a), (a, wide))
                out[f"{side}b{k}"] = np.zeros((1, wide))
        return Autoencoder(sizes, out, variational)

    def _run(self, x: Tensor, p: dict[str, Tensor], side: str) -> Tensor:
        last = len(self.layers) - 2
        for k in range(last + 1):
            x = x @ p[f"{side}w{k}"] + p[f"{side}b{k}"]
            if k < last:
                x = x.leaky()
        return x

    def encode(self, x: Tensor, p: dict[str, Tensor]) -> Tensor:
        z = self._run(x, p, "e")
        return z[:, : self.layers[-1]] if self.variational else z

    def moments(self, x: Tensor, p: dict[str, Tensor]) -> tuple[Tensor, Tensor]:
        """Means and log-variances of a variational encoder."""
        z = self._run(x, p, "e")
        return z[:, : self.layers[-1]], z[:, self.layers[-1] :]

    def decode(self, z: Tensor, p: dict[str, Tensor]) -> Tensor:
        return self._run(z, p, "d")

    def embed(self, x: np.ndarray) -> np.ndarray:
        return self.encode(Tensor(x), {k: Tensor(v) for k, v in self.parameters.items()}).data

    def transform(self, points: DataFrame, name: str = "features") -> DataFrame:
        """Points with their embeddings as features."""

        @F.pandas_udf("array<double>")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(list(self.embed(np.stack(features))) if len(features) else [], dtype=object)

        return points.withColumn(name, run("features"))

    def with_parameters(self, p: Parameters) -> Autoencoder:
        return replace(self, parameters={k: p[k] for k in self.parameters})


def reconstruction(net: Autoencoder):
    """Loss of an autoencoder: squared error summed over features, mean over points."""

    def loss(x: np.ndarray, p: dict[str, Tensor], rng, other: np.ndarray | None = None) -> Tensor:
        if other is not None:
            return (loss(x, p, rng) + loss(other, p, rng)) * 0.5
        diff = net.decode(net.encode(Tensor(x), p), p) - x
        return (diff * diff).sum(1).mean()

    return loss


def variational(net: Autoencoder, weight: float = 1.0):
    """Squared error of a drawn embedding, and the divergence of its distribution from the unit normal."""

    def loss(x: np.ndarray, p: dict[str, Tensor], rng) -> Tensor:
        mean, log_var = net.moments(Tensor(x), p)
        z = mean + (log_var * 0.5).exp() * rng.normal(size=mean.shape)
        diff = net.decode(z, p) - x
        apart = (mean * mean + log_var.exp() - log_var - 1.0).sum(1) * 0.5
        return (diff * diff).sum(1).mean() + apart.mean() * weight

    return loss


def adam_steps(x: np.ndarray, start: Parameters, loss: Callable, batch: int, rate: float, rng, fixed: frozenset = frozenset(), extra: np.ndarray | None = None) -> tuple[Parameters, float]:
    """One pass over rows in random batches; parameters in ``fixed`` stay."""
    values = {k: v.copy() for k, v in start.items()}
    first, second = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
    order, total, step = rng.permutation(len(x)), 0.0, 0
    for a in range(0, len(x), batch):
        rows = order[a : a + batch]
        p = {k: Tensor(v) for k, v in values.items()}
        out = loss(x[rows], p, rng) if extra is None else loss(x[rows], p, rng, extra[rows])
        out.backward()
        total += float(out.data) * len(rows)
        step += 1
        for k, v in values.items():
            if k in fixed:
                continue
            g = p[k].grad
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            v -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return values, total


def _packed(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpacked(flat: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def epoch(points: DataFrame, start: Parameters, loss: Callable, batch: int = 256, rate: float = 1e-3, seed: int = 0, fixed: frozenset = frozenset(), extra: str | None = None) -> tuple[Parameters, float]:
    """Averaged parameters after one epoch, and the mean loss.

    ``extra``: an array column that the loss takes beside the features.
    """
    columns = ["features"] + ([extra] if extra else [])

    def run(frames):
        held = [f for f in frames if len(f)]
        if not held:
            return
        frame = pd.concat(held, ignore_index=True)
        x = np.stack(frame["features"]).astype(float)
        more = np.stack(frame[extra]).astype(float) if extra else None
        # in an order of their own, so that a task run again, whose rows come as they like, draws the same batches
        order = np.lexsort(x.T)
        x, more = x[order], None if more is None else more[order]
        rng = np.random.default_rng([seed, len(x), zlib.crc32(x[0].tobytes())])
        own, total = adam_steps(x, start, loss, batch, rate, rng, fixed, more)
        flat = np.concatenate([_packed(own) * len(x), [total, len(x)]])
        for k in range(0, len(flat), PIECE):
            yield pd.DataFrame({"piece": [k], "data": [flat[k : k + PIECE].tobytes()]})

    def add(key, frame):
        parts = [np.frombuffer(d) for d in frame["data"]]
        return pd.DataFrame({"piece": [key[0]], "data": [np.sum(parts, axis=0).tobytes()]})

    pieces = points.select(*columns).mapInPandas(run, "piece long, data binary").groupBy("piece").applyInPandas(add, "piece long, data binary").collect()
    if not pieces:
        raise ValueError("no points")
    flat = np.concatenate([np.frombuffer(r["data"]) for r in sorted(pieces, key=lambda r: r["piece"])])
    return _unpacked(flat[:-2] / flat[-1], start), float(flat[-2] / flat[-1])


def paired_epoch(points: DataFrame, start: Parameters, loss: Callable, batch: int, rate: float, seed: int, augment: Callable | None) -> tuple[Parameters, float]:
    """An epoch whose loss takes, with ``augment``, augmented rows drawn for this seed beside the rows."""
    if augment is None:
        return epoch(points, start, loss, batch, rate, seed)
    return epoch(with_augmented(points, augment, seed), start, loss, batch, rate, seed, extra=OTHER)


def pretrain(points: DataFrame, layers, epochs: int = 100, batch: int = 256, rate: float = 1e-3, seed: int = 0, variational_weight: float | None = None, augment: Callable | None = None) -> tuple[Autoencoder, list[float]]:
    """A trained autoencoder and the mean loss of each epoch; with ``augment`` (see :mod:`quillon.deep.augment`) augmented rows are reconstructed beside the others."""
    if augment is not None and variational_weight is not None:
        raise ValueError("no augmentation of a variational autoencoder")
    net = Autoencoder.create(layers, seed, variational_weight is not None)
    loss = reconstruction(net) if variational_weight is None else variational(net, variational_weight)
    losses, p = [], net.parameters
    for e in range(epochs):
        p, value = paired_epoch(points, p, loss, batch, rate, seed + e, augment)
        losses.append(value)
    return net.with_parameters(p), losses
