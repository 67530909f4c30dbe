"""Low-dimensional placements of points: landmark Isomap and t-SNE with grid interpolation.

Neighbours come from the tiles of :mod:`quillon.operators.geometry`; all further
work is joins over the neighbour edges and sums over tasks, and the driver holds
what belongs to landmarks or to the grid, whose sizes are parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import geometry as geo
from quillon.operators.eigen import times
from quillon.operators.lineage import cut
from quillon.operators.partition import scatter

NEAR = 3  # interpolation nodes in each direction of a box


def graph_components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, comp): smallest id that edges (i, j) in both directions lead to; labels jump to their label's label each round."""
    comps = cut(ids.select("id", F.col("id").alias("comp")))
    while True:
        offers = edges.join(comps.select(F.col("id").alias("i"), "comp"), "i").groupBy(F.col("j").alias("id")).agg(F.min("comp").alias("offer"))
        lower = comps.join(offers, "id", "left").select("id", F.col("comp").alias("was"), F.least("comp", F.coalesce("offer", "comp")).alias("comp"))
        jump = lower.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        after = cut(lower.join(jump, "comp").select("id", "was", F.col("to").alias("comp")))
        comps = after.select("id", "comp")
        if after.where("was <> comp").isEmpty():
            return comps


def neighbour_graph(points: DataFrame, neighbours: int = 10, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, j, w): both directions of each point's edges to its nearest others, made connected.

    While there are several components, each gets its shortest edge to another
    (a round of Boruvka), found tile by tile.
    """
    near = geo.nearest(points, neighbours, id_col, features).select("i", "j", F.col("d").alias("w"))
    both = lambda e: e.unionAll(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).distinct()
    edges, ids = cut(both(near)), points.select(F.col(id_col).alias("id"))
    kind = points.schema[id_col].dataType.simpleString()
    while True:
        comps = graph_components(edges, ids)
        if comps.select("comp").distinct().limit(2).count() < 2:
            return edges

        def shortest(a, b, d, same):
            d = np.where(a["comp"][:, None] == b["comp"][None, :], np.inf, d)
            at, rows = d.argmin(1), np.arange(len(d))
            held = np.isfinite(d[rows, at])
            return pd.DataFrame({"comp": a["comp"][held], "i": a["id"][held], "j": b["id"][at][held], "w": d[rows, at][held]})

        rows = points.select(F.col(id_col).alias("id"), F.col(features).alias("features")).join(comps, "id")
        found = geo.per_tile(geo.tiles(rows, "id", "features", ("comp",)), shortest, f"comp {kind}, i {kind}, j {kind}, w double")
        links = found.groupBy("comp").agg(F.min(F.struct("w", "i", "j")).alias("e")).select("e.i", "e.j", "e.w")
        edges = cut(edges.unionAll(both(links)).distinct())


def geodesics(edges: DataFrame, ids: DataFrame, landmarks: list) -> DataFrame:
    """(id, g): lengths of the shortest paths from each landmark, infinite where there is none.

    Bellman-Ford for all landmarks at once; only nodes that came nearer to some
    landmark in a round make offers in the next, and a round is a join with their
    edges and a minimum by node.  There are as many rounds as the longest
    shortest path has edges.
    """
    n = len(landmarks)
    start = F.array(*[F.when(F.col("id") == F.lit(x), 0.0).otherwise(F.lit(math.inf)) for x in landmarks])
    state = cut(ids.select("id", start.alias("g")).withColumn("moved", F.array_contains("g", 0.0)))
    while not (moved := state.where("moved")).isEmpty():
        offers = edges.join(moved.select(F.col("id").alias("i"), "g"), "i").groupBy(F.col("j").alias("id")).agg(*[F.min(F.col("w") + F.col("g")[k]).alias(f"o{k}") for k in range(n)])
        joined = state.join(offers, "id", "left").select("id", F.col("g").alias("was"), F.when(F.col("o0").isNull(), F.col("g")).otherwise(F.zip_with("g", F.array(*[f"o{k}" for k in range(n)]), lambda a, b: F.least(a, b))).alias("g"))
        state = cut(joined.select("id", "g", F.exists(F.zip_with("was", "g", lambda a, b: b < a), lambda x: x).alias("moved")))
    return state.select("id", "g")


def isomap(points: DataFrame, dims: int = 2, neighbours: int = 10, landmarks: int = 100, id_col: str = "id", features: str = "features") -> DataFrame:
    """(id, features): landmark Isomap (de Silva and Tenenbaum).

    ``landmarks``: how many points, those of the smallest id hashes, are scaled
    by their geodesic distances; all points are then placed by their distances to
    them.  With all points as landmarks this is Isomap itself.
    """
    ids = points.select(F.col(id_col).alias("id"))
    chosen = [r["id"] for r in ids.orderBy(F.xxhash64("id"), "id").limit(landmarks).collect()]
    paths = geodesics(neighbour_graph(points, neighbours, id_col, features), ids, chosen)
    own = {r["id"]: r["g"] for r in paths.where(F.col("id").isin(chosen)).collect()}  # landmarks x landmarks
    d2 = np.array([own[x] for x in chosen], float) ** 2
    mean = d2.mean(0)
    b = -0.5 * (d2 - mean - mean[:, None] + d2.mean())
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(-values)[:dims]
    held = values[order] > 1e-12 * max(values.max(), 1e-300)
    pull = np.where(held, vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), 0.0)
    squares = paths.select("id", F.transform("g", lambda x, k: (F.array(*[F.lit(float(m)) for m in mean])[k] - x * x) / 2).alias("q"))
    return times(squares, pull).select(F.col("id").alias(id_col), F.col("q").alias("features"))


def _bandwidths(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Neighbour probabilities of one point by bisection of the precision."""
    d2 = d2 - d2.min()
    low, high, beta = 0.0, math.inf, 1.0
    for _ in range(60):
        p = np.exp(-beta * d2)
        total = p.sum()
        entropy = math.log(total) + beta * float((p * d2).sum()) / total
        if abs(entropy - math.log(perplexity)) < 1e-6:
            break
        low, high = (beta, high) if entropy > math.log(perplexity) else (low, beta)
        beta = beta * 2 if math.isinf(high) else (low + high) / 2
    return p / total


def affinities(points: DataFrame, perplexity: float = 30.0, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, j, p): symmetric neighbour probabilities, which add up to 1, over three times the perplexity of neighbours."""
    near = geo.nearest(points, int(3 * perplexity), id_col, features)

    @F.pandas_udf("array<double>")
    def own(d: pd.Series) -> pd.Series:
        return pd.Series([_bandwidths(np.asarray(x, float) ** 2, min(perplexity, max(1.0, len(x) / 3))) for x in d], dtype=object)

    lists = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j", "d"))).alias("l"))
    lists = lists.select("i", F.col("l.j").alias("j"), own(F.col("l.d")).alias("p"))
    pairs = lists.select("i", F.explode(F.arrays_zip("j", "p")).alias("e")).select("i", "e.j", "e.p")
    n = points.count()
    both = pairs.unionAll(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    return both.groupBy("i", "j").agg((F.sum("p") / (2.0 * n)).alias("p"))


@dataclass(frozen=True)
class Grid:
    """Boxes over a square, each with NEAR x NEAR nodes at equal distances."""

    low: float
    step: float  # between nodes
    nodes: int  # in each direction

    @staticmethod
    def over(low: float, high: float, boxes: int) -> Grid:
        span = max(high - low, 1e-9) * (1 + 1e-9)
        return Grid(low, span / (boxes * NEAR), boxes * NEAR)

    def weights(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First node of each coordinate's box, and Lagrange weights of the box's nodes."""
        box = np.clip(((x - self.low) / (self.step * NEAR)).astype(int), 0, self.nodes // NEAR - 1)
        at = self.low + self.step * (box[:, None] * NEAR + np.arange(NEAR) + 0.5)
        w = np.ones((len(x), NEAR))
        for a in range(NEAR):
            for b in range(NEAR):
                if a != b:
                    w[:, a] *= (x - at[:, b]) / (at[:, a] - at[:, b])
        return box * NEAR, w

    def cells(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, NEAR^2) cells and weights."""
        (r, a), (c, b) = self.weights(y[:, 0]), self.weights(y[:, 1])
        k = np.arange(NEAR)
        cells = (r[:, None, None] + k[:, None]) * self.nodes + c[:, None, None] + k
        return cells.reshape(len(y), -1), (a[:, :, None] * b[:, None, :]).reshape(len(y), -1)

    def potentials(self, charges: np.ndarray) -> tuple[np.ndarray, float]:
        """(nodes^2, 3): squared kernel over charges (1, y1, y2); and the sum of the plain kernel over all pairs of charge 1."""
        offset = np.minimum(np.arange(2 * self.nodes), 2 * self.nodes - np.arange(2 * self.nodes)) * self.step
        kernel = 1 / (1 + offset[:, None] ** 2 + offset[None, :] ** 2)
        grids = charges.reshape(self.nodes, self.nodes, -1)
        spread = lambda k, q: np.fft.irfft2(np.fft.rfft2(k) * np.fft.rfft2(q, k.shape), k.shape)[: self.nodes, : self.nodes]
        total = float((spread(kernel, grids[:, :, 0]) * grids[:, :, 0]).sum())
        return np.stack([spread(kernel**2, grids[:, :, c]).ravel() for c in range(3)], axis=1), total


def _charges(state: DataFrame, grid: Grid) -> np.ndarray:
    """What all points put on the nodes: 1 and both coordinates, dealt by the weights; added up over tasks."""

    def add(batches):
        total = np.zeros((grid.nodes**2, 3))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cells, w = grid.cells(y)
            for c, q in enumerate((np.ones(len(y)), y[:, 0], y[:, 1])):
                total[:, c] += np.bincount(cells.ravel(), (w * q[:, None]).ravel(), grid.nodes**2)
        used = np.flatnonzero(total.any(1))
        if len(used):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int64())} | {f"q{c}": pa.array(total[used, c]) for c in range(3)})

    rows = state.select("y").mapInArrow(add, "cell long, q0 double, q1 double, q2 double").groupBy("cell").agg(*[F.sum(f"q{c}").alias(f"q{c}") for c in range(3)])
    out, held = np.zeros((grid.nodes**2, 3)), rows.toPandas()  # nodes of the grid
    out[held["cell"].to_numpy()] = held[["q0", "q1", "q2"]].to_numpy()
    return out


def attraction(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """(id, a0, a1): sum of p / (1 + d2) times the difference to each neighbour; ``pairs`` (i, j, p), ``state`` (id, y)."""
    ends = pairs.join(state.select(F.col("id").alias("j"), F.col("y").alias("b")), "j").join(state.select(F.col("id").alias("i"), F.col("y").alias("a")), "i")
    diff = [F.col("a")[c] - F.col("b")[c] for c in range(2)]
    pull = F.col("p") / (1.0 + diff[0] * diff[0] + diff[1] * diff[1])
    return ends.groupBy(F.col("i").alias("id")).agg(*[F.sum(pull * diff[c]).alias(f"a{c}") for c in range(2)])


def with_gradient(pairs: DataFrame, state: DataFrame, boxes: int, exaggeration: float = 1.0) -> DataFrame:
    """``state`` (id, y, ..) with the gradient g (2 numbers) of the divergence; one pass for the grid, one for the neighbours."""
    low, high = state.agg(F.min(F.array_min("y")), F.max(F.array_max("y"))).first()
    grid = Grid.over(low, high, boxes)
    field, total = grid.potentials(_charges(state, grid))
    n = state.count()
    field = state.sparkSession.sparkContext.broadcast(field / max(total - n, 1e-300))  # of the size of the grid

    @F.pandas_udf("array<double>")
    def repulsion(ys: pd.Series) -> pd.Series:
        if not len(ys):
            return pd.Series([], dtype=object)
        y = np.stack(ys)
        cells, w = grid.cells(y)
        f = np.einsum("pk,pkc->pc", w, field.value[cells])
        return pd.Series(list(y * f[:, :1] - f[:, 1:]), dtype=object)

    pulled = state.withColumn("r", repulsion("y")).join(attraction(pairs, state), "id", "left")
    return pulled.withColumn("g", F.array(*[4.0 * (exaggeration * F.coalesce(f"a{c}", F.lit(0.0)) - F.col("r")[c]) for c in range(2)])).drop("r", "a0", "a1")


def principal_start(points: DataFrame, spread: float = 1e-4) -> DataFrame:
    """(id, y): the first two principal components, of standard deviation ``spread`` along the first."""
    n, mean, s = scatter(points)
    values, vectors = np.linalg.eigh(s / n)
    axes = vectors[:, ::-1][:, :2] * (spread / math.sqrt(max(values[-1], 1e-300)))
    centred = points.select("id", F.zip_with(F.col("features").cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m).alias("q"))
    return times(centred, axes).select("id", F.col("q").alias("y"))


def tsne(points: DataFrame, perplexity: float = 30.0, iterations: int = 250, exaggerated: int = 100, rate: float | None = None, spread: float = 1e-4, boxes: int = 50, id_col: str = "id", features: str = "features") -> DataFrame:
    """(id, features): t-SNE in two dimensions from the principal components, repulsion by interpolation on a grid (Linderman et al.).

    ``exaggerated``: first iterations, of twelvefold attraction.  ``boxes``: of
    the grid in each direction; the placement's span over it is how coarse the
    interpolation is.  ``spread``: of the start along its first axis; from 1 far
    fewer iterations do.  Each iteration is a checkpoint.
    """
    rows = points.select(F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("features"))
    pairs = cut(affinities(rows, perplexity).repartition("j"))
    state = cut(principal_start(rows, spread).withColumns({"v": F.array(F.lit(0.0), F.lit(0.0)), "s": F.array(F.lit(1.0), F.lit(1.0))}))
    n = state.count()
    rate = max(n / 48.0, 10.0) if rate is None else rate
    for t in range(iterations):
        early = t < exaggerated
        moved = with_gradient(pairs, state, boxes, 12.0 if early else 1.0)
        gain = [F.greatest(F.lit(0.01), F.when(F.col("v")[c] * F.col("g")[c] < 0, F.col("s")[c] + 0.2).otherwise(F.col("s")[c] * 0.8)) for c in range(2)]
        moved = moved.withColumn("s", F.array(*gain))
        moved = moved.withColumn("v", F.array(*[(0.5 if early else 0.8) * F.col("v")[c] - rate * F.col("s")[c] * F.col("g")[c] for c in range(2)]))
        state = cut(moved.select("id", F.array(*[F.col("y")[c] + F.col("v")[c] for c in range(2)]).alias("y"), "v", "s"))
    return state.select(F.col("id").alias(id_col), F.col("y").alias("features"))
