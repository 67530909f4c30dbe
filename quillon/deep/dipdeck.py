"""DipDECK: too many clusters at first, of which those are merged whose dip finds no gap between them.

The dips of all pairs of clusters come from histograms of projections: a pass for
the ranges, a pass for the counts, k (k - 1) / 2 of ``bins`` numbers added up over
tasks.  A dip changes by no more than the distribution function does, so the
error is at most half the share of the fullest bin and half of one over
``POINTS``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.deep.autograd import Tensor, squared_distances
from quillon.deep.clustering import DeepModel, _reconstruction
from quillon.deep.networks import Autoencoder, epoch, pretrain
from quillon.functions.dip import dip_test, p_value_of
from quillon.operators.partition import _nearest, kmeans

#: Quantiles of a histogram that its dip is taken of.
POINTS = 4096


def histogram_dip(counts: np.ndarray, low: float, high: float) -> tuple[float, float, float]:
    """Dip and modal interval of as many points as counted, POINTS at most, at even quantiles; points of a bin are spread over it evenly."""
    n = int(counts.sum())
    if n < 4 or high <= low:
        return 0.0, low, high
    edges = np.linspace(low, high, len(counts) + 1)
    held = np.flatnonzero(counts)
    rank = (np.arange(min(n, POINTS)) + 0.5) / min(n, POINTS) * n
    before = np.concatenate([[0], np.cumsum(counts[held])])
    at = np.clip(np.searchsorted(before, rank, side="right") - 1, 0, len(held) - 1)
    x = edges[held[at]] + (rank - before[at]) / counts[held][at] * (edges[1] - edges[0])
    found = dip_test(x, True)
    return found.value, float(x[found.interval[0]]), float(x[found.interval[1]])


def dip_of_histogram(counts: np.ndarray, low: float, high: float) -> float:
    return histogram_dip(counts, low, high)[0]


def _summed(points: DataFrame, work, width: int) -> np.ndarray:
    """Sums over tasks of what ``work(x)`` gives for blocks of points, ``width`` numbers."""

    def add(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += work(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_pydict({"pos": pa.array(used, pa.int64()), "x": pa.array(total[used])})

    rows = points.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(add, "pos long, x double").groupBy("pos").agg(F.sum("x").alias("x"))
    out, held = np.zeros(width), rows.toPandas()
    out[held["pos"].to_numpy()] = held["x"].to_numpy()
    return out


def pair_histograms(rows: DataFrame, axes: np.ndarray, pairs: list[tuple[int, int]], parted, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends (pairs, 2) of each pair's projections, and counts (pairs, 2, bins) of its two clusters; two passes.

    ``parted(x)`` gives points and cluster numbers of a block of features.
    """
    of: dict[int, list[int]] = {}
    for p, pair in enumerate(pairs):
        for c in pair:
            of.setdefault(c, []).append(p)

    def ends(batches):
        low, high = np.full(len(pairs), np.inf), np.full(len(pairs), -np.inf)
        for batch in batches:
            if batch.num_rows:
                x, at = parted(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                for c in [c for c in np.unique(at) if c in of]:
                    z = x[at == c] @ axes[of[c]].T
                    low[of[c]], high[of[c]] = np.minimum(low[of[c]], z.min(0)), np.maximum(high[of[c]], z.max(0))
        used = np.flatnonzero(np.isfinite(low))
        if len(used):
            yield pa.RecordBatch.from_pydict({"pos": pa.array(used, pa.int64()), "low": pa.array(low[used]), "high": pa.array(high[used])})

    features = rows.select(F.col("features").cast("array<double>").alias("features"))
    span = np.tile([0.0, 1.0], (len(pairs), 1))
    for r in features.mapInArrow(ends, "pos long, low double, high double").groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        span[r["pos"]] = r["low"], r["high"]

    def count(block):
        out = np.zeros((len(pairs), 2, bins))
        x, at = parted(block)
        for c in [c for c in np.unique(at) if c in of]:
            z = x[at == c] @ axes[of[c]].T
            for q, p in enumerate(of[c]):
                low, high = span[p]
                bin_of = np.clip(((z[:, q] - low) / max(high - low, 1e-300) * bins).astype(int), 0, bins - 1)
                out[p, int(c == pairs[p][1])] += np.bincount(bin_of, minlength=bins)
        return out.ravel()

    return span, _summed(rows, count, len(pairs) * 2 * bins).reshape(len(pairs), 2, bins)


def dip_matrix(embedded: DataFrame, centres: np.ndarray, bins: int = 1024, factor: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """p-values (k, k) of each pair of clusters along the line through their centres, and the clusters' sizes.

    Of two clusters of unlike size the larger counts as ``factor`` times the
    smaller at most: its points nearest to the other centre are taken, whole bins
    of them.  A pair one of which is empty has p-value 0.
    """
    k = len(centres)
    pairs = list(itertools.combinations(range(k), 2))
    axes = np.array([centres[b] - centres[a] for a, b in pairs]).reshape(len(pairs), -1)
    span, counts = pair_histograms(embedded, axes, pairs, lambda x: (x, _nearest(x, centres)), bins)
    sizes = np.zeros(k)
    out = np.eye(k)
    for p, (a, b) in enumerate(pairs):
        first, second = counts[p]
        sizes[a], sizes[b] = first.sum(), second.sum()
        if min(sizes[a], sizes[b]) == 0:
            out[a, b] = out[b, a] = 0.0
            continue
        if sizes[a] > factor * sizes[b]:  # the side towards b is that of the high bins
            first = _nearest_bins(first[::-1], factor * sizes[b])[::-1]
        elif sizes[b] > factor * sizes[a]:
            second = _nearest_bins(second, factor * sizes[a])
        both = first + second
        out[a, b] = out[b, a] = p_value_of(dip_of_histogram(both, *span[p]), int(both.sum()))
    return out, sizes


def _nearest_bins(counts: np.ndarray, most: float) -> np.ndarray:
    """Counts of the first bins, up to and with the one in which ``most`` is reached."""
    return np.where(np.cumsum(counts) - counts < most, counts, 0)


@dataclass(frozen=True)
class DipDeck:
    model: DeepModel
    #: Number of clusters after each epoch.
    counts: tuple[int, ...]

    @property
    def k(self) -> int:
        return len(self.model.centres)

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        return self.model.predict(points, name)


def _merged(centres: np.ndarray, dips: np.ndarray, sizes: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    """The centres with a pair replaced by its mean, weighted by size, at the end."""
    a, b = pair
    joint = (sizes[a] * centres[a] + sizes[b] * centres[b]) / max(sizes[a] + sizes[b], 1)
    return np.concatenate([np.delete(centres, [a, b], axis=0), joint[None]])


def dip_deck(points: DataFrame, k: int = 35, layers=(), merge_at: float = 0.9, weight: float = 1.0, reconstruct: float = 1.0, least: int = 1, most: int | None = None, pretrain_epochs: int = 100, epochs: int = 50, bins: int = 1024, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> DipDeck:
    """Start with k clusters; between epochs merge the pair of the largest dip p-value while it reaches ``merge_at``.

    In an epoch each embedded point is drawn to the centres of clusters in
    proportion to their dip p-value with its own, so clusters that may be one
    move together.  Not fewer than ``least`` clusters remain; more than ``most``
    are merged by falling p-value in the end.
    """
    if net is None:
        net, _ = pretrain(points, layers, pretrain_epochs, batch, rate, seed)
    centres = kmeans(net.transform(points), k, seed).centres
    losses, ks = [], []

    def merged(centres: np.ndarray, bound: float, stop: int) -> tuple[np.ndarray, np.ndarray]:
        while True:
            embedded = net.transform(points)
            dips, sizes = dip_matrix(embedded, centres, bins)
            if (sizes == 0).any() and len(centres) > 1:
                centres = centres[sizes > 0]
                continue
            apart = dips - 2 * np.eye(len(dips))
            pair = np.unravel_index(apart.argmax(), apart.shape)
            if len(centres) <= stop or apart[pair] < bound:
                return centres, dips
            centres = _merged(centres, dips, sizes, pair)

    for e in range(epochs):
        centres, dips = merged(centres, merge_at, least)
        pull = dips / dips.sum(1, keepdims=True)

        def loss(x, p, rng, pull=pull):
            z = net.encode(Tensor(x), p)
            c = p["centres"]
            at = _nearest(z.data, c.data)
            spread = max(float(((c.data[:, None] - c.data[None]) ** 2).sum(2).sum() / max(len(c.data) * (len(c.data) - 1), 1)), 1e-12) if len(c.data) > 1 else 1.0
            return _reconstruction(net, x, z, p) * reconstruct + (squared_distances(z, c) * pull[at]).sum(1).mean() * (weight / spread)

        p, value = epoch(points, {**net.parameters, "centres": centres}, loss, batch, rate, seed + e)
        net, centres = net.with_parameters(p), p["centres"]
        losses.append(value)
        ks.append(len(centres))
    centres, _ = merged(centres, merge_at, least)
    if most is not None and len(centres) > most:
        centres, _ = merged(centres, 0.0, most)
    return DipDeck(DeepModel(net, centres, tuple(losses)), tuple(ks))
