"""DeepECT: a tree of centres that grows inside the training of an embedding.

Points belong to their nearest leaf and to all nodes above it.  Between epochs one
pass sums the residuals of all leaves over tasks; it gives the nodes' weights,
which leaves have died, and which leaf costs most and is split next.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.deep.autograd import Tensor
from quillon.deep.clustering import _reconstruction
from quillon.deep.networks import Autoencoder, epoch, pretrain
from quillon.operators.partition import _moments, _nearest, _split_all


@dataclass(frozen=True)
class CentreTree:
    """Node k splits into ``children[k]``, or is a leaf; node 0 is the root.  ``born``: the split that made a node."""

    centres: dict[int, np.ndarray]
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    born: dict[int, int] = field(default_factory=dict)

    @property
    def leaves(self) -> list[int]:
        """Leaves from left to right."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            if node in self.children:
                stack += reversed(self.children[node])
            else:
                out.append(node)
        return out

    def leaf_centres(self) -> np.ndarray:
        return np.array([self.centres[k] for k in self.leaves])

    def parents(self) -> dict[int, int]:
        return {c: k for k, pair in self.children.items() for c in pair}

    def split(self, leaf: int, pair: np.ndarray) -> CentreTree:
        a = max(self.centres) + 1
        turn = max(self.born.values(), default=0) + 1
        return CentreTree({**self.centres, a: pair[0], a + 1: pair[1]}, {**self.children, leaf: (a, a + 1)}, {**self.born, a: turn, a + 1: turn})

    def without(self, leaf: int) -> CentreTree:
        """The tree whose parent of a leaf is replaced by the leaf's sibling."""
        up = self.parents()
        if leaf not in up:
            raise ValueError("the root stays")
        parent = up[leaf]
        sibling = next(c for c in self.children[parent] if c != leaf)
        centres = {k: c for k, c in self.centres.items() if k not in (leaf, sibling)} | {parent: self.centres[sibling]}
        children = {k: v for k, v in self.children.items() if k not in (parent, sibling)}
        if sibling in self.children:
            children[parent] = self.children[sibling]
        return CentreTree(centres, children, {k: b for k, b in self.born.items() if k not in (leaf, sibling)})

    def weighted(self, leaf_centres: np.ndarray, weights: np.ndarray) -> CentreTree:
        """New centres of the leaves; those of inner nodes are the means of their leaves by weight."""
        centres, sums = {}, {}
        for k, c, w in zip(self.leaves, leaf_centres, np.maximum(weights, 1e-300)):
            centres[k], sums[k] = c, w
        for k in sorted(self.children, key=lambda k: self.born.get(k, 0), reverse=True):
            a, b = self.children[k]
            sums[k] = sums[a] + sums[b]
            centres[k] = (sums[a] * centres[a] + sums[b] * centres[b]) / sums[k]
        return replace(self, centres=centres)

    def projections(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every node but the root: the unit vector from its sibling, where its centre is on it, and (leaves, nodes) who is below."""
        leaves, up = self.leaves, self.parents()
        nodes = sorted(up)
        place = {k: i for i, k in enumerate(nodes)}
        axes, at = np.zeros((len(nodes), len(self.centres[0]))), np.zeros(len(nodes))
        for k in nodes:
            sibling = next(c for c in self.children[up[k]] if c != k)
            apart = self.centres[k] - self.centres[sibling]
            axes[place[k]] = apart / max(np.linalg.norm(apart), 1e-12)
            at[place[k]] = axes[place[k]] @ self.centres[k]
        below = np.zeros((len(leaves), len(nodes)))
        for i, k in enumerate(leaves):
            while k in up:
                below[i, place[k]] = 1.0
                k = up[k]
        return axes, at, below

    def flat(self, k: int) -> np.ndarray:
        """A number for each leaf, when all but the first k - 1 splits that are left are undone."""
        if not 1 <= k <= len(self.leaves):
            raise ValueError("k is between 1 and the number of leaves")
        done = sorted(self.children, key=lambda x: self.born[self.children[x][0]])[: k - 1]
        up, tops = self.parents(), []
        for leaf in self.leaves:
            top = leaf
            while top in up and up[top] not in done:
                top = up[top]
            tops.append(top)
        return np.unique(tops, return_inverse=True)[1]


def grown(embedded: DataFrame, tree: CentreTree, least: int = 0) -> CentreTree:
    """The tree after its most costly leaf was split by 2-means; unchanged if no leaf has two different points.

    ``least``: leaves with fewer points go first, and every centre of a leaf is the mean of its points.
    """
    n, r, _ = (m[:, 0] for m in _moments(embedded, tree.leaf_centres()))
    for leaf in [k for k, size in zip(tree.leaves, n) if size < max(least, 1)]:
        if len(tree.leaves) > 1:
            tree = tree.without(leaf)
    n, r, _ = (m[:, 0] for m in _moments(embedded, tree.leaf_centres()))
    tree = tree.weighted(tree.leaf_centres() + r / np.maximum(n, 1)[:, None], n)
    pairs, n, _, cost = _split_all(embedded, tree.leaf_centres())
    order = [i for i in np.argsort(-cost, kind="stable") if n[i].min() > 0 and cost[i] > 0]
    if not order:
        return tree
    tree = tree.split(tree.leaves[order[0]], pairs[order[0]])
    # the mean of the split leaf is that of its new leaves
    return tree


@dataclass(frozen=True)
class DeepTree:
    net: Autoencoder
    tree: CentreTree
    losses: tuple[float, ...] = ()

    def predict(self, points: DataFrame, k: int | None = None, name: str = "cluster") -> DataFrame:
        """Points with the number of their leaf, or of their cluster in the flat cut of k."""
        centres = self.tree.leaf_centres()
        of = np.arange(len(centres)) if k is None else self.tree.flat(k)

        @F.pandas_udf("int")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(of[_nearest(self.net.embed(np.stack(features)), centres)] if len(features) else [], dtype="int32")

        return points.withColumn(name, run("features"))


def tree_loss(net: Autoencoder, tree: CentreTree, reconstruct: float = 1.0):
    """Leaf centres follow the mean of their points in the batch; points are drawn along the lines between siblings, on all levels; and the reconstruction."""
    axes, at, below = tree.projections()

    def loss(x, p, rng):
        z = net.encode(Tensor(x), p)
        own = _nearest(z.data, p["leaves"].data)
        total = _reconstruction(net, x, z, p) * reconstruct
        if len(axes):
            apart = (z @ axes.T - at).abs() * below[own]
            total = total + apart.sum() * (1 / (len(x) * len(below)))
        used, inverse = np.unique(own, return_inverse=True)
        share = np.zeros((len(used), len(x)))
        share[inverse, np.arange(len(x))] = 1.0
        diff = p["leaves"][used] - (share / share.sum(1, keepdims=True)) @ z.data
        return total + (diff * diff).sum() * (1 / len(below))

    return loss


def deep_ect(points: DataFrame, layers, most_leaves: int = 20, grow_every: int = 2, least_share: float = 0.01, reconstruct: float = 1.0, pretrain_epochs: int = 100, epochs: int = 200, batch: int = 256, rate: float = 1e-3, seed: int = 0, net: Autoencoder | None = None) -> DeepTree:
    """Every ``grow_every`` epochs leaves under ``least_share`` of the points are cut off and the most costly one is split, up to ``most_leaves``."""
    if net is None:
        net, _ = pretrain(points, layers, pretrain_epochs, batch, rate, seed)
    n = points.count()
    tree = CentreTree({0: np.zeros(net.layers[-1])})
    losses = []
    for e in range(epochs):
        if e % grow_every == 0 and len(tree.leaves) < most_leaves:
            tree = grown(net.transform(points), tree, int(least_share * n))
        p, value = epoch(points, {**net.parameters, "leaves": tree.leaf_centres()}, tree_loss(net, tree, reconstruct), batch, rate, seed + e)
        net = net.with_parameters(p)
        weights = _moments(net.transform(points), p["leaves"])[0][:, 0]
        tree = tree.weighted(p["leaves"], weights)
        losses.append(value)
    return DeepTree(net, tree, tuple(losses))
