"""Spectral clustering with the number of clusters from a concentration bound (SpecialK)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import geometry as geo
from quillon.operators.eigen import leading
from quillon.operators.lineage import cut
from quillon.operators.partition import Model, _moments, kmeans


def neighbourhood(points: DataFrame, neighbours: int, share: float, id_col: str = "id", features: str = "features") -> float:
    """The distance that ``share`` of the points reach their k-th neighbour at."""
    reach = geo.nearest(points, neighbours, id_col, features).groupBy("i").agg(F.max("d").alias("d"))
    return reach.agg(F.percentile("d", share)).first()[0]


def radius_graph(points: DataFrame, neighbours: int = 10, share: float = 0.99, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, j, w) of all ordered pairs closer than the distance that ``share`` of the points reach their k-th neighbour at; w is the distance."""
    kind = points.schema[id_col].dataType.simpleString()
    radius = neighbourhood(points, neighbours, share, id_col, features)

    def work(a, b, d, same):
        d, inside = geo.within(a["f"], b["f"], radius)
        i, j = np.nonzero(inside & (a["id"][:, None] != b["id"][None, :]))
        return pd.DataFrame({"i": a["id"][i], "j": b["id"][j], "w": d[i, j]})

    return geo.per_tile(geo.tiles(points, id_col, features), work, f"i {kind}, j {kind}, w double", None)


def radius_graph_degrees(points: DataFrame, neighbours: int = 10, share: float = 0.99, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, degree, total): edges of each point in :func:`radius_graph` and the sum of their weights, for points that have one.

    Added up within the tiles, in which each pair is met once, so that no edge leaves a task.
    """
    kind = points.schema[id_col].dataType.simpleString()
    radius = neighbourhood(points, neighbours, share, id_col, features)
    radius = -1.0 if radius is None else radius

    def work(a, b):
        other = a if b is None else b
        degree, total = [np.zeros(len(x["f"]), np.int64) for x in (a, other)], [np.zeros(len(x["f"])) for x in (a, other)]
        for s, t, same in geo.block_pairs(a, b):
            x, y = a["f"][s], other["f"][t]
            d2, off = geo._products(x, y)
            i, j = np.nonzero(d2 <= radius * radius + off[:, None])
            d = geo.paired_distances(x, y, i, j)
            inside = (d <= radius) & (a["id"][s][i] != other["id"][t][j])
            i, j, d = i[inside], j[inside], d[inside]
            for side, block, at, n in ((0, s, i, len(x)),) if same else ((0, s, i, len(x)), (1, t, j, len(y))):
                degree[side][block] += np.bincount(at, minlength=n)
                total[side][block] += np.bincount(at, d, minlength=n)
        for side, x in enumerate((a, other)):
            some = degree[side] > 0
            yield pd.DataFrame({"i": x["id"][some], "degree": degree[side][some], "total": total[side][some]})

    tiled = geo.tiles(points, id_col, features, half=True)
    return geo.per_tile_of_stripes(tiled, work, f"i {kind}, degree long, total double").groupBy("i").agg(F.sum("degree").alias("degree"), F.sum("total").alias("total"))


def normalised_graph(points: DataFrame, neighbours: int = 10, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, j, w): the symmetric k-nearest-neighbour graph of distances, each entry over the root of both degrees."""
    near = geo.nearest(points, neighbours, id_col, features).select("i", "j", "d")
    both = near.unionAll(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    edges = both.groupBy("i", "j").agg((F.sum("d") / 2).alias("w"))
    degree = edges.groupBy("i").agg(F.sum("w").alias("di"))
    scaled = edges.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("di").alias("dj")), "j")
    return scaled.select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(i, j, w): half the sum of both directions of an edge table."""
    both = edges.select("i", "j", "w").unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))


def embedding(edges: DataFrame, ids: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """(id, features): abs of the leading eigenvectors by absolute eigenvalue times its root; nothing of the size of the graph leaves Spark."""
    values, rows = leading(edges, dims, ids, seed=seed)
    roots = F.array(*[F.lit(float(math.sqrt(abs(v)))) for v in values])
    return cut(rows.select("id", F.zip_with("q", roots, lambda x, r: F.abs(x) * r).alias("features")))


def _bound(n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> float:
    """Log of a bound on the probability that two groups of rows are one cluster; 0 at most.

    ``n`` (2,), sums and sums of squares (2, dims) of both groups.  Columns are
    centred and scaled to their length over both; the bound is Bernstein's on the
    larger squared length of a group's sum per row (Hess et al., 2019).
    """
    size = np.sqrt(s2.sum(0))
    size = np.where(size > 0, size, 1)
    mean, rows, m = s1.sum(0) / n.sum(), n.sum(), s1.shape[1]
    variance = float(((s2.sum(0) - rows * mean**2) / size**2).sum()) / (rows * m)
    lengths = (((s1 - n[:, None] * mean) / size) ** 2).sum(1)
    t = float((lengths / np.maximum(n, 1)).max()) - variance * m
    spread = m * variance + t / 3
    return min(0.0, math.log(rows) - 0.5 * t * t / spread) if spread > 0 else 0.0


def log_bound(d: np.ndarray, first: np.ndarray, second: np.ndarray) -> float:
    """:func:`_bound` of the rows at two sets of positions."""
    groups = [d[first], d[second]]
    return _bound(np.array([len(g) for g in groups], float), np.array([g.sum(0) for g in groups]), np.array([(g**2).sum(0) for g in groups]))


def special_k(points: DataFrame, significance: float = 0.01, dims: int = 200, graph: str | DataFrame = "NAM", neighbours: int = 5, share: float = 0.99, pairs: int = 10, max_k: int | None = None, seed: int = 0, id_col: str = "id", features: str = "features") -> tuple[DataFrame, int]:
    """(id, cluster) and k: clusters are added until two of them may be one.

    ``graph``: NAM (neighbourhood radius), SAM (normalised neighbours), or an
    edge table (i, j, w), of which the mean of both directions is taken.  The
    embedding comes from block Lanczos; each k costs the passes of k-means, one
    for the sums of all clusters and one over the edges, and the driver sees
    sums of clusters and cuts between them.
    """
    if graph not in ("NAM", "SAM") and not isinstance(graph, DataFrame):
        raise ValueError("graph is NAM, SAM or an edge table")
    ids = points.select(F.col(id_col).alias("id"))
    edges = graph if isinstance(graph, DataFrame) else radius_graph(points, neighbours, share, id_col, features) if graph == "NAM" else normalised_graph(points, neighbours, id_col, features)
    edges = cut(symmetric(edges))
    n = ids.count()
    rows = embedding(edges, ids, min(dims, n - 1), seed)
    labels, k = rows.select("id", F.lit(0).alias("cluster")), 1
    while k < n and (max_k is None or k < max_k):
        model: Model = kmeans(rows, k + 1, seed)
        new = cut(model.predict(rows).select("id", "cluster"))
        size, r, q = (m[:, 0] for m in _moments(rows, model.centres))
        if (size == 0).any():
            break
        s1, s2 = r + size[:, None] * model.centres, q + 2 * model.centres * r + size[:, None] * model.centres**2
        ends = edges.join(new.select(F.col("id").alias("i"), F.col("cluster").alias("a")), "i").join(new.select(F.col("id").alias("j"), F.col("cluster").alias("b")), "j")
        cuts = {(x["a"], x["b"]): x["w"] for x in ends.where("a > b").groupBy("a", "b").agg(F.sum("w").alias("w")).collect()}  # pairs of clusters
        near = sorted((-cuts.get((a, b), 0.0), a, b) for a in range(k + 1) for b in range(a))[:pairs]  # the pairs with the largest cut
        if max(_bound(size[[a, b]], s1[[a, b]], s2[[a, b]]) for _, a, b in near) > math.log(significance):
            break
        labels, k = new, k + 1
    return labels.withColumnRenamed("id", id_col), k
