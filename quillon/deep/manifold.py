"""Clustering of a manifold placement of an embedding: N2D and DDC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillon.deep.networks import Autoencoder, pretrain
from quillon.operators import density, manifold
from quillon.operators.lineage import cut
from quillon.operators.mixture import Mixture, mixture


@dataclass(frozen=True)
class Placed:
    """Network, the placement (id, features) of its embedding, and the labels (id, cluster) found in it."""

    net: Autoencoder
    placement: DataFrame
    labels: DataFrame
    n_clusters: int
    mixture: Mixture | None = None


def _embedded(points, layers, net, epochs, batch, rate, seed):
    if net is None:
        net, _ = pretrain(points, layers, epochs, batch, rate, seed)
    return net, cut(net.transform(points).select("id", "features"))


def _placed(embedded: DataFrame, method: str, options: dict) -> DataFrame:
    if method not in ("isomap", "tsne"):
        raise ValueError("method is isomap or tsne")
    return cut(getattr(manifold, method)(embedded, **options))


def n2d(points: DataFrame, k: int, layers, method: str = "isomap", options: dict | None = None, pretrain_epochs: int = 100, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> Placed:
    """A Gaussian mixture in the placement of an autoencoder's embedding.

    ``method``: isomap, by default in k dimensions, or tsne, in two; ``options``
    go to it.
    """
    net, embedded = _embedded(points, layers, net, pretrain_epochs, batch, rate, seed)
    place = _placed(embedded, method, options if options is not None else {"dims": k} if method == "isomap" else {})
    found = mixture(place, k, repeats=3, seed=seed)
    return Placed(net, place, found.predict(place).select("id", "cluster"), k, found)


def ddc(points: DataFrame, layers, ratio: float = 0.1, method: str = "tsne", options: dict | None = None, pretrain_epochs: int = 100, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> Placed:
    """Density peaks, with no k given, in the two-dimensional placement of an autoencoder's embedding."""
    net, embedded = _embedded(points, layers, net, pretrain_epochs, batch, rate, seed)
    place = _placed(embedded, method, options or {})
    labels, k = density.density_peak_clusters(place, ratio)
    return Placed(net, place, labels, k)
