"""Clustering driven by the dip: splits of multimodal clusters, modal intervals per dimension, multimodal projections."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.dip import dip_test, gradient, p_value_gradient, p_value_of
from quillon.functions.unidip import unidip
from quillon.operators import geometry as geo
from quillon.operators.partition import Model, kmeans, lloyd, scatter
from quillon.operators.subspace import turned


def split_in_two(points: DataFrame, model: Model, cluster: int, trials: int = 10, seed: int = 0) -> Model:
    """The model with one cluster split: the best of some pairs (a member, its mirror image at the centre), refitted with all others."""
    own = model.predict(points).where(F.col("cluster") == cluster)
    chosen = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(trials).select("features").collect()
    rest = np.delete(model.centres, cluster, axis=0)
    centre = model.centres[cluster]
    starts = [np.concatenate([rest, [x], [2 * centre - x]]) for x in (np.array(r["features"], float) for r in chosen)]
    return min((lloyd(points, s) for s in starts), key=lambda m: m.inertia)


def viewer_scores(points: DataFrame, significance: float, share: float, label: str = "cluster", p_value=p_value_of) -> dict[int, float]:
    """For each cluster the mean dip of its split viewers, 0 if they are too few.

    A viewer is a point; it splits if the distances from it to its cluster are
    not unimodal.  Distances are gathered per viewer from the tiles.
    """
    kind = points.schema["id"].dataType.simpleString()

    def work(a, b, d, same):
        rows = []
        for k, (i, c) in enumerate(zip(a["id"], a[label])):
            own = b[label] == c
            if own.any():
                rows.append((i, int(c), d[k, own]))
        return pd.DataFrame(rows, columns=["i", "cluster", "part"])

    parts = geo.per_tile(geo.tiles(points, "id", "features", (label,)), work, f"i {kind}, cluster int, part array<double>")
    seen = parts.groupBy("i", "cluster").agg(F.flatten(F.collect_list("part")).alias("d"))

    @F.pandas_udf("double")
    def dips(d: pd.Series) -> pd.Series:
        found = [(dip_test(x).value, len(x)) for x in d]
        return pd.Series([v if p_value(v, n) < significance else float("nan") for v, n in found], dtype=float)

    scored = seen.select("cluster", dips("d").alias("dip")).groupBy("cluster").agg(F.count("*").alias("n"), F.count(F.when(~F.isnan("dip"), 1)).alias("split"), F.avg(F.when(~F.isnan("dip"), F.col("dip"))).alias("mean"))
    return {r["cluster"]: (r["mean"] if r["split"] > share * r["n"] else 0.0) or 0.0 for r in scored.collect()}


def dip_means(points: DataFrame, significance: float = 0.001, viewers: float = 0.01, trials: int = 10, k: int = 1, max_k: int | None = None, seed: int = 0, p_value=p_value_of) -> Model:
    """k-means whose most multimodal cluster, as its own points see it, is split until none is."""
    model = kmeans(points, k, seed)
    while max_k is None or model.k < max_k:
        scores = viewer_scores(model.predict(points), significance, viewers, p_value=p_value)
        worst = max(scores, key=lambda c: (scores[c], -c))
        if scores[worst] <= 0:
            break
        model = split_in_two(points, model, worst, trials, seed + model.k)
    return model


def projected_p_values(points: DataFrame, axes: np.ndarray, label: str = "cluster", p_value=p_value_of) -> dict[int, tuple[float, float, int]]:
    """For each cluster (p-value, dip, axis) of its largest dip over the original and the given axes; a task holds one cluster along one axis."""

    @F.pandas_udf("array<double>")
    def project(features: pd.Series) -> pd.Series:
        x = np.stack(features)
        return pd.Series(list(np.concatenate([x, x @ axes], axis=1)) if len(features) else [], dtype=object)

    def run(key, frame):
        return pd.DataFrame({"cluster": [key[0]], "axis": [key[1]], "n": [len(frame)], "dip": [dip_test(frame["x"].to_numpy()).value]})

    long = points.select(label, F.posexplode(project("features")).alias("axis", "x"))
    rows = long.groupBy(F.col(label).cast("int").alias("cluster"), "axis").applyInPandas(run, "cluster int, axis int, n long, dip double").collect()
    best: dict[int, tuple] = {}
    for r in rows:
        if r["cluster"] not in best or (r["dip"], -r["axis"]) > (best[r["cluster"]][0], -best[r["cluster"]][2]):
            best[r["cluster"]] = (r["dip"], r["n"], r["axis"])
    return {c: (p_value(d, n), d, a) for c, (d, n, a) in best.items()}


def projected_dip_means(points: DataFrame, significance: float = 0.001, random_axes: int = 0, trials: int = 10, k: int = 1, max_k: int | None = None, seed: int = 0, p_value=p_value_of) -> Model:
    """k-means whose cluster of the least p-value, along original, principal and random axes, is split while it is significant."""
    model = kmeans(points, k, seed)
    rng = np.random.default_rng(seed)
    while max_k is None or model.k < max_k:
        labelled = model.predict(points)
        found = {}
        for c in range(model.k):
            own = labelled.where(F.col("cluster") == c)
            n, _, s = scatter(own) if own.limit(1).count() else (0, None, None)
            if n < 4:
                continue
            axes = np.linalg.eigh(s)[1][:, ::-1]
            if random_axes:
                axes = np.concatenate([axes, rng.normal(size=(len(s), random_axes))], axis=1)
            found |= projected_p_values(own, axes, p_value=p_value)
        if not found:
            break
        worst = min(found, key=lambda c: (found[c][0], -found[c][1], c))
        if found[worst][0] >= significance:
            break
        model = split_in_two(points, model, worst, trials, seed + model.k)
    return model


def skinny_dip(points: DataFrame, significance: float = 0.05, add_tails: bool = False, outliers: bool = True, size_factor: float = 2.0, id_col: str = "id", features: str = "features", p_value=p_value_of) -> DataFrame:
    """(id, cluster): modal intervals within each cluster, dimension by dimension; -1 is noise.

    A task holds one coordinate of one cluster.  New clusters are numbered in
    the order of the old ones.
    """
    kind = points.schema[id_col].dataType.simpleString()
    dims = points.select(F.max(F.size(features))).first()[0] or 0
    labels = points.select(F.col(id_col).alias("id"), F.lit(0).alias("cluster"), F.col(features).alias("f"))
    clusters = 1
    for dim in range(dims):

        def run(key, frame):
            if key[0] < 0:
                return pd.DataFrame({"id": frame["id"], "old": key[0], "new": -1})
            frame = frame.sort_values("id", kind="stable")
            new, _ = unidip(frame["x"].to_numpy(), significance, add_tails, outliers, size_factor, p_value)
            return pd.DataFrame({"id": frame["id"], "old": key[0], "new": new})

        parts = labels.select("id", "cluster", F.col("f")[dim].alias("x")).groupBy("cluster").applyInPandas(run, f"id {kind}, old int, new int").checkpoint()
        more = {r["old"]: r["k"] for r in parts.where("old >= 0").groupBy("old").agg((F.max("new") + 1).alias("k")).collect()}  # one row a cluster
        first, base = {}, clusters
        for old in sorted(more):
            first[old] = base
            base += max(0, more[old] - 1)
        clusters = base
        offsets = F.create_map(*[F.lit(x) for old in sorted(first) for x in (old, first[old])]) if first else F.create_map().cast("map<int,int>")
        number = F.when(F.col("new") < 0, -1).when(F.col("new") == 0, F.col("old")).otherwise(offsets[F.col("old")] + F.col("new") - 1).cast("int")
        labels = parts.select("id", number.alias("cluster")).join(points.select(F.col(id_col).alias("id"), F.col(features).alias("f")), "id")
    return labels.select(F.col("id").alias(id_col), "cluster")


def default_starts(dims: int) -> int:
    return int(math.log(dims)) + 1


def tie_ranges(projected: np.ndarray, triangle: tuple[int, int, int]) -> list[list[int]]:
    """Ranks with the same value as each corner of a modal triangle; corners of one value keep to the part between their neighbours."""
    out = []
    for k, t in enumerate(triangle):
        low, high = (int(np.searchsorted(projected, projected[t], side=s)) for s in ("left", "right"))
        if k and projected[triangle[k - 1]] == projected[t]:
            low = triangle[k - 1] + 1
        if k < 2 and projected[triangle[k + 1]] == projected[t]:
            high = triangle[k + 1]
        out.append(list(range(low, high)))
    return out


def _dip_along(x: np.ndarray, axis: np.ndarray, ties: str, rng) -> tuple[float, np.ndarray]:
    """Dip of a projection and its gradient; corners of equal value: as sorted, one drawn, or of all choices the steepest gradient (one climb, not one for each choice)."""
    projected = x @ axis
    order = np.argsort(projected, kind="stable")
    found = dip_test(projected[order], True)
    if found.triangle[0] < 0 or found.triangle[1] < 0 or ties == "ignore":
        return found.value, gradient(x, projected, order, found.triangle)
    ranges = tie_ranges(projected[order], found.triangle)
    if ties == "random":
        swapped = order.copy()
        for t, own in zip(found.triangle, ranges):
            swapped[t] = order[own[int(rng.integers(len(own)))]]
        return found.value, gradient(x, projected, swapped, found.triangle)
    if ties != "all":
        raise ValueError("ties are ignore, random or all")
    best = np.zeros(x.shape[1])
    for a in ranges[0]:
        for b in ranges[1]:
            for c in ranges[2]:
                swapped = order.copy()
                swapped[list(found.triangle)] = order[[a, b, c]]
                g = gradient(x, projected, swapped, found.triangle)
                best = g if np.linalg.norm(g) > np.linalg.norm(best) else best
    return found.value, best


def climb(axis: np.ndarray, slope, first: float = 0.5, rest: float = 1e-3, enough: float = 1e-4) -> tuple[float, np.ndarray]:
    """Value and axis of a local maximum on the unit sphere, by steepest ascent along great circles.

    ``slope(axis)`` gives value and gradient.  A step turns by an angle, at first
    ``first`` radians, in the gradient's tangential direction, and is halved until
    the value rises by ``enough`` times what the gradient promises (Armijo); after
    a step the next may be twice as long.  Ends where angles under ``rest`` do
    not help.  The value never falls, so the last axis is the best.
    """
    value, g = slope(axis)
    turn = first
    while True:
        along = g - (g @ axis) * axis
        steep = float(np.linalg.norm(along))
        if steep == 0:
            return value, axis
        while turn >= rest:
            tried = math.cos(turn) * axis + math.sin(turn) * along / steep
            tried /= np.linalg.norm(tried)
            after, after_g = slope(tried)
            if after >= value + enough * turn * steep:
                break
            turn /= 2
        else:
            return value, axis
        value, g, axis, turn = after, after_g, tried, min(2 * turn, first)


@dataclass(frozen=True)
class DipExtModel:
    """Orthogonal axes by falling dip; ``low`` and ``span`` of each for scaling."""

    axes: np.ndarray
    dips: np.ndarray
    low: np.ndarray
    span: np.ndarray
    scaled: bool

    def values(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return (z - self.low) / self.span * self.dips if self.scaled else z

    def transform(self, points: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(list(self.values(np.stack(features))) if len(features) else [], dtype=object)

        return points.withColumn("features", run("features"))


def _gathered(points: DataFrame, limit: int) -> np.ndarray:
    """At most ``limit`` points, those of the smallest id hashes, for searches of an axis on the driver."""
    rows = points.orderBy(F.xxhash64("id"), "id").limit(limit).select("features").collect()
    if not rows:
        raise ValueError("no points")
    return np.array([r["features"] for r in rows], float)


def dip_ext(points: DataFrame, components: int | None = None, scaling: bool = True, threshold: float = 0.5, starts: int | None = None, ties: str = "ignore", sample: int = 20_000, seed: int = 0) -> DipExtModel:
    """Orthogonal axes along which the data are most multimodal.

    Each is found by gradient ascent of the dip from the best axes, in the space
    orthogonal to those before; the search ends where the dip falls under
    ``threshold`` times the largest, or at ``components``.  Axes are fitted on
    at most ``sample`` points; the transform covers all.
    """
    x = _gathered(points, sample)
    d, rng = x.shape[1], np.random.default_rng(seed)
    basis, axes, dips = np.eye(d), [], []
    while basis.shape[1] and len(axes) < (components or d):
        z = x @ basis
        m = z.shape[1]
        own = [dip_test(z[:, j]).value for j in range(m)]
        tries = np.argsort(own)[::-1][: starts or default_starts(m)]
        value, axis = max((climb(np.eye(m)[j], lambda v: _dip_along(z, v, ties, rng)) for j in tries), key=lambda f: f[0])
        if components is None and dips and value < threshold * max(dips):
            break
        axes.append(basis @ axis)
        dips.append(value)
        q, _ = np.linalg.qr(np.concatenate([axis[:, None], np.eye(m)], axis=1))
        basis = basis @ q[:, 1:m]
    order = np.argsort(dips, kind="stable")[::-1]
    frame, dips = np.array(axes).T[:, order], np.array(dips)[order]
    ends = turned(points, frame).select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("dim").collect()
    low, high = np.array([r["lo"] for r in ends]), np.array([r["hi"] for r in ends])
    return DipExtModel(frame, dips, low, np.where(high > low, high - low, 1.0), scaling)


@dataclass(frozen=True)
class DipInitModel:
    space: DipExtModel
    model: Model

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        inner = self.model.predict(self.space.transform(points), name)
        return points.join(inner.select("id", name), "id")


def dip_init(points: DataFrame, k: int = 8, **options) -> DipInitModel:
    """k-means in the multimodal space: means of k equal parts along its first axis, then one axis more at a time."""
    space = dip_ext(points, **options)
    inside = space.transform(points)
    model = None
    for m in range(1, space.axes.shape[1] + 1):
        part = inside.withColumn("features", F.slice("features", 1, m))
        if model is None:
            marks = part.select(F.percentile(F.col("features")[0], F.array(*[F.lit((j + 0.5) / k) for j in range(k)])).alias("q")).first()["q"]
            start = np.array(marks)[:, None]
        else:
            counted = model.predict(inside.withColumn("features", F.slice("features", 1, m - 1)).select("id", "features")).select("id", "cluster")
            means = part.join(counted, "id").groupBy("cluster").agg(F.avg(F.col("features")[m - 1]).alias("x")).collect()
            last = {r["cluster"]: r["x"] for r in means}
            start = np.concatenate([model.centres, [[last.get(c, 0.0)] for c in range(model.k)]], axis=1)
        model = lloyd(part, start)
    return DipInitModel(space, model)


@dataclass(frozen=True)
class DipNSubModel:
    """Axes of the multimodal subspace and the label of every point it was fitted on."""

    axes: np.ndarray
    labels: DataFrame
    n_clusters: int


def _weighted_p(x: np.ndarray, labels: np.ndarray, axis: np.ndarray) -> tuple[float, np.ndarray, dict[int, float]]:
    """Negative size-weighted p-value of the clusters along an axis, its gradient, and each cluster's p-value."""
    total, slope, each = 0.0, np.zeros(x.shape[1]), {}
    kept = labels >= 0
    n = max(int(kept.sum()), 1)
    for c in np.unique(labels[kept]):
        own = x[labels == c]
        if len(own) < 4:
            each[int(c)] = 1.0
            total += len(own) / n
            continue
        projected = own @ axis
        order = np.argsort(projected, kind="stable")
        found = dip_test(projected[order], True)
        each[int(c)] = p_value_of(found.value, len(own))
        total += len(own) / n * each[int(c)]
        slope += len(own) / n * p_value_gradient(own, projected, order, found.triangle, found.value)
    return -total, -slope, each


def dip_n_sub(points: DataFrame, significance: float = 0.01, threshold: float = 0.15, starts: int | None = None, add_tails: bool = True, outliers: bool = False, seed: int = 0) -> DipNSubModel:
    """Clusters and their subspace: axes of the least weighted p-value, each split by modal intervals, while enough points are in multimodal clusters.

    The search is sequential in axes and looks at all points of all clusters
    at each step, so the points are gathered.
    """
    rows = sorted(points.select("id", "features").collect(), key=lambda r: r["id"])
    x = np.array([r["features"] for r in rows], float)
    n, d = x.shape
    labels, clusters, basis, axes = np.zeros(n, np.int64), 1, np.eye(d), []
    while basis.shape[1]:
        z = x @ basis
        m = z.shape[1]
        _, principal = np.linalg.eigh(np.cov(z.T).reshape(m, m))
        candidates = [*np.eye(m), *principal.T]
        ranked = sorted(candidates, key=lambda v: _weighted_p(z, labels, v)[0], reverse=True)[: starts or default_starts(m)]
        _, axis = max((climb(v, lambda w: _weighted_p(z, labels, w)[:2]) for v in ranked), key=lambda f: f[0])
        each = _weighted_p(z, labels, axis)[2]
        multimodal = [c for c, p in each.items() if p < significance]
        if axes and sum((labels == c).sum() for c in multimodal) < threshold * n:
            break
        for c in multimodal:
            own = np.flatnonzero(labels == c)
            new, _ = unidip(z[own] @ axis, significance, add_tails, outliers)
            labels[own] = np.where(new < 0, -1, np.where(new == 0, c, clusters + new - 1))
            clusters += max(0, int(new.max()))
        axes.append(basis @ axis)
        if not multimodal:
            break
        q, _ = np.linalg.qr(np.concatenate([axis[:, None], np.eye(m)], axis=1))
        basis = basis @ q[:, 1:m]
    kind = points.schema["id"].dataType.simpleString()
    table = points.sparkSession.createDataFrame([(r["id"], int(c)) for r, c in zip(rows, labels)], f"id {kind}, cluster int")
    return DipNSubModel(np.array(axes).T, table, clusters)

