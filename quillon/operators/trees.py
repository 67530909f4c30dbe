"""Cluster trees: their paths, and purities as plans over class counts of leaves.

A tree is model state of a bounded number of nodes.  Points know their leaf
only; a count of each (leaf, class) comes first, so that what is joined with
the tree's paths has as many rows as the tree has leaves and classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ClusterTree:
    """A binary tree whose leaves are clusters; splitting leaf c leaves c and a new cluster.

    A node is named by its path: r for the root, then 0 or 1 for each step.
    """

    def __init__(self):
        self.parent: dict[str, str | None] = {"r": None}
        self.leaf: dict[int, str] = {0: "r"}
        self.created: list[str] = ["r"]

    def split(self, cluster: int, new: int | None = None) -> tuple[int, int]:
        """Split a leaf; the new cluster's number is the next free one if none is given."""
        if cluster not in self.leaf:
            raise ValueError(f"{cluster} is no leaf")
        new = max(self.leaf) + 1 if new is None else new
        if new in self.leaf:
            raise ValueError(f"{new} is a leaf already")
        node = self.leaf[cluster]
        self.parent |= {node + "0": node, node + "1": node}
        self.created += [node + "0", node + "1"]
        self.leaf[cluster], self.leaf[new] = node + "0", node + "1"
        return cluster, new

    def labels_below(self, node: str) -> list[int]:
        return sorted(c for c, x in self.leaf.items() if x.startswith(node))

    def lowest_common_ancestor(self, a: int, b: int) -> str:
        x, y = self.leaf[a], self.leaf[b]
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return x[:n]

    def leaf_and_split_nodes(self) -> tuple[list[str], list[str]]:
        """Leaves and inner nodes, level by level."""
        inner = {p for p in self.parent.values() if p is not None}
        by_level = sorted(self.parent, key=lambda x: (len(x), x))
        return [x for x in by_level if x not in inner], [x for x in by_level if x in inner]

    def delete(self, node: str) -> None:
        """Remove a subtree; its sibling takes the place of their parent."""
        above = self.parent[node]
        if above is None:
            raise ValueError("the root cannot be deleted")
        sibling = above + ("1" if node.endswith("0") else "0")
        moved = lambda x: above + x[len(sibling) :] if x.startswith(sibling) else x
        gone = lambda x: x.startswith(node) or x == sibling
        self.leaf = {c: moved(x) for c, x in self.leaf.items() if not x.startswith(node)}
        self.parent = {moved(x): p if p is None else moved(p) for x, p in self.parent.items() if not gone(x)}
        self.created = [moved(x) for x in self.created if not gone(x)]

    def prune(self, leaves: int) -> dict[int, int]:
        """Keep the nodes of the first ``leaves - 1`` splits; gives the new cluster of each old one, numbered by their smallest."""
        if not 1 <= leaves <= len(self.leaf):
            raise ValueError("cannot keep more leaves than there are, nor none")
        kept = set(self.created[: 2 * leaves - 1])
        ends = {c: max((x[:k] for k in range(1, len(x) + 1) if x[:k] in kept), key=len) for c, x in self.leaf.items()}
        smallest: dict[str, int] = {}
        for c in sorted(ends):
            smallest.setdefault(ends[c], c)
        number = {c: k for k, c in enumerate(sorted(smallest.values()))}
        self.parent = {x: p for x, p in self.parent.items() if x in kept}
        self.created = self.created[: 2 * leaves - 1]
        self.leaf = {number[c]: x for x, c in smallest.items()}
        return {c: number[smallest[end]] for c, end in ends.items()}

    def linkage(self, distance=None) -> list[tuple[int, int, float, int]]:
        """Merges (left, right, distance, leaves) from the deepest node up, as dendrogram plots take them.

        ``distance(node)``: height of an inner node, 0 if None.
        """
        leaves, inner = self.leaf_and_split_nodes()
        number = {self.leaf[c]: k for k, c in enumerate(sorted(self.leaf))}
        size = {x: 1 for x in leaves}
        rows = []
        for node in sorted(inner, key=lambda x: (distance(x) if distance else 0.0, -len(x), x)):
            a, b = node + "0", node + "1"
            size[node] = size[a] + size[b]
            rows.append((number[a], number[b], float(distance(node)) if distance else 0.0, size[node]))
            number[node] = len(leaves) + len(rows) - 1
        return rows

    def paths(self, spark: SparkSession) -> DataFrame:
        """(leaf, path): the nodes from the root to each cluster's leaf."""
        rows = [(c, [node[: k + 1] for k in range(len(node))]) for c, node in self.leaf.items()]
        return spark.createDataFrame(rows, "leaf long, path array<string>")


def linkage_paths(spark: SparkSession, merges: list[tuple[int, int]]) -> DataFrame:
    """(leaf, path) of a merge table whose row k makes node n + k of two earlier nodes, n leaves in all."""
    n = len(merges) + 1
    parent = {child: n + k for k, pair in enumerate(merges) for child in pair}
    if len(parent) != 2 * len(merges):
        raise ValueError("a node is merged more than once")
    rows = []
    for leaf in range(n):
        path = [leaf]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        rows.append((leaf, [str(x) for x in path[::-1]]))
    return spark.createDataFrame(rows, "leaf long, path array<string>")


def leaf_purity(points: DataFrame, leaf: str = "leaf", true: str = "true") -> DataFrame:
    """(leaf_purity): share of the points in the majority class of their leaf."""
    counts = points.groupBy(F.col(leaf).alias("leaf"), F.col(true).alias("true")).agg(F.count("*").alias("n"))
    best = counts.groupBy("leaf").agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return best.agg(F.round(F.sum("best") / F.sum("size"), 6).alias("leaf_purity"))


def node_purity(points: DataFrame, paths: DataFrame, leaf: str = "leaf", true: str = "true") -> DataFrame:
    """(node, purity) of every node with points."""
    counts = _node_counts(points, paths, leaf, true)
    return counts.groupBy("node").agg(F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


def _node_counts(points: DataFrame, paths: DataFrame, leaf: str, true: str) -> DataFrame:
    """(node, parent, true, n)"""
    counts = points.groupBy(F.col(leaf).alias("leaf"), F.col(true).alias("true")).agg(F.count("*").alias("n"))
    steps = paths.select("leaf", "path", F.posexplode("path").alias("at", "node")).select("leaf", "node", F.when(F.col("at") > 0, F.expr("path[at - 1]")).alias("parent"))
    return counts.join(steps, "leaf").groupBy("node", "parent", "true").agg(F.sum("n").alias("n"))


def dendrogram_purity(points: DataFrame, paths: DataFrame, leaf: str = "leaf", true: str = "true") -> DataFrame:
    """(dendrogram_purity): over pairs of one class, the mean class share at the node where they first meet.

    Pairs that meet at a node are all its pairs without those of its children,
    so trees of any fan-out are handled and points are never paired.
    """
    counts = _node_counts(points, paths, leaf, true)
    n = F.col("n").cast("decimal(19,0)")
    pairs = (n * (n - 1) / 2).cast("double")
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("node"))).withColumn("pairs", pairs)
    below = share.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), "true").agg(F.sum("pairs").alias("below"))
    own = share.join(below, ["node", "true"], "left").withColumn("own", F.col("pairs") - F.coalesce("below", F.lit(0.0)))
    return own.agg(F.round(F.sum(F.col("own") * F.col("share")) / F.sum("own"), 6).alias("dendrogram_purity"))
