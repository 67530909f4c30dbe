"""Non-redundant and subspace clustering with sufficient statistics.

A model is an orthogonal matrix, whose columns are dealt among subspaces, and
the centres of each.  A round reads the points once: every task assigns its
points in all subspaces and adds up counts, sums and outer products; rotations
are then eigenproblems of d x d matrices on the driver.  Points never leave the
executors.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.gaussian import bic_costs, common_costs, generalised_eigen, integer_costs, is_orthogonal, probability_costs
from quillon.operators import geometry as geo
from quillon.operators.partition import _nearest, _seed, held as kept_for_passes, kmeans, scatter
from quillon.sources.synthetic import rotation as random_rotation

THRESHOLD = -1e-7


@dataclass(frozen=True)
class Space:
    columns: tuple[int, ...]
    centres: np.ndarray  # k x d, in the original space
    scatter: np.ndarray = field(default=None)  # within clusters, without outliers
    counts: np.ndarray = field(default=None)
    outliers: int = 0
    limits: float = math.inf  # largest squared distance of a member

    @property
    def k(self) -> int:
        return len(self.centres)

    @property
    def dims(self) -> int:
        return len(self.columns)


@dataclass(frozen=True)
class NrModel:
    """Fitted subspaces; a space of one cluster is a noise space and comes last."""

    rotation: np.ndarray
    spaces: tuple[Space, ...]
    n: int
    rounds: int
    max_distance: float | None = None
    precision: float | None = None
    with_outliers: bool = False

    def axes(self, s: int) -> np.ndarray:
        return self.rotation[:, list(self.spaces[s].columns)]

    def cost(self) -> float:
        """Sum of the traces of the scatter matrices in their subspaces."""
        return sum(float(np.trace(self.axes(s).T @ x.scatter @ self.axes(s))) for s, x in enumerate(self.spaces))

    def labels(self, x: np.ndarray, outliers: bool = True) -> np.ndarray:
        return np.stack([_space_labels(x, self.rotation, s, outliers) for s in self.spaces], axis=1)

    def predict(self, points: DataFrame, name: str = "labels") -> DataFrame:
        """Points with an array of one label a subspace, -1 for outliers."""

        @F.pandas_udf("array<int>")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(list(self.labels(np.stack(features)).astype("int32")) if len(features) else [], dtype=object)

        return points.withColumn(name, run("features"))

    def transform(self, points: DataFrame, s: int | None = None) -> DataFrame:
        """Features turned by the whole rotation, or into one subspace."""
        return turned(points, self.rotation if s is None else self.axes(s))

    def mdl(self) -> tuple[float, float, list[float]]:
        """Total, global and per-subspace bits."""
        if self.max_distance is None or self.precision is None:
            raise ValueError("description lengths need max_distance and precision")
        each = []
        for s, x in enumerate(self.spaces):
            bits = integer_costs(max(x.dims, 1), True) + integer_costs(x.k, True)
            bits += x.k * reference_vector_costs(x.dims, self.max_distance, self.precision) + bic_costs(self.n, True)
            if self.with_outliers:
                bits += integer_costs(x.outliers, True) if x.outliers else math.log2(2.865064)
                bits += x.outliers * (math.log2(self.n) + uniform_costs(x.dims, self.max_distance))
            bits += (self.n - x.outliers) * probability_costs(1 / x.k)
            bits += common_costs(x.dims, x.scatter, self.n - x.outliers, self.axes(s)) + self.n * precision_costs(x.dims, self.precision)
            each.append(bits)
        whole = integer_costs(len(self.spaces), True)
        return whole + sum(each), whole, each

    def without_noise(self, by_mdl: bool = True, seed: int = 0) -> NrModel:
        """The noise space's dimensions given to the cluster spaces: each to the one of least bits, or drawn."""
        if len(self.spaces) < 2 or self.spaces[-1].k != 1:
            return self
        rng, spaces = np.random.default_rng(seed), list(self.spaces[:-1])
        for column in self.spaces[-1].columns:
            tries = [[replace(x, columns=(*x.columns, column)) if j == k else x for j, x in enumerate(spaces)] for k in range(len(spaces))]
            best = min(range(len(tries)), key=lambda k: replace(self, spaces=tuple(tries[k])).mdl()[0]) if by_mdl else int(rng.integers(len(tries)))
            spaces = tries[best]
        return replace(self, spaces=tuple(spaces))


def uniform_costs(dims: int, max_distance: float) -> float:
    return dims * math.log2(max_distance)


def precision_costs(dims: int, precision: float) -> float:
    return -dims * math.log2(precision)


def reference_vector_costs(dims: int, max_distance: float, precision: float) -> float:
    return uniform_costs(dims, max_distance) + precision_costs(dims, precision)


def turned(points: DataFrame, axes: np.ndarray) -> DataFrame:
    """Points with features times a matrix."""

    @F.pandas_udf("array<double>")
    def run(features: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(features) @ axes) if len(features) else [], dtype=object)

    return points.withColumn("features", run("features"))


def _space_labels(x: np.ndarray, v: np.ndarray, space: Space, outliers: bool = True) -> np.ndarray:
    axes = v[:, list(space.columns)]
    z, c = x @ axes, space.centres @ axes
    at = _nearest(z, c)
    if outliers and math.isfinite(space.limits):
        at = np.where(((z - c[at]) ** 2).sum(1) > space.limits, -1, at)
    return at


def smallest_gaps(points: DataFrame) -> float:
    """Mean over dimensions of the smallest positive gap between values.

    Values are dealt by range; a task reports the ends and the smallest gap of
    what it holds of a dimension, and gaps across tasks follow from the ends.
    """
    long = points.select(F.posexplode("features").alias("dim", "x")).repartitionByRange("dim", "x").sortWithinPartitions("dim", "x")

    def run(frames):
        held: dict[int, list[float]] = {}
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                x = np.unique(part["x"].to_numpy())
                low, high, gap = held.get(int(dim), (x[0], x[0], math.inf))
                gaps = np.diff(np.concatenate(([high], x)))
                gaps = gaps[gaps > 0]
                held[int(dim)] = [low, float(x[-1]), min(gap, float(gaps.min()) if len(gaps) else math.inf)]
        yield pd.DataFrame([(d, *v) for d, v in held.items()], columns=["dim", "low", "high", "gap"])

    rows = long.mapInPandas(run, "dim int, low double, high double, gap double").collect()  # a row for each task and dimension
    found = []
    for dim, own in itertools.groupby(sorted(rows, key=lambda r: (r["dim"], r["low"])), key=lambda r: r["dim"]):
        own = list(own)
        gaps = [r["gap"] for r in own] + [b["low"] - a["high"] for a, b in zip(own, own[1:]) if b["low"] > a["high"]]
        if math.isfinite(min(gaps)):
            found.append(min(gaps))
    return float(np.mean(found)) if found else 1.0


def _statistics(points: DataFrame, v: np.ndarray, spaces, before=None, outliers: bool = False):
    """Counts, sums and outer products of the members of each space, and counts of (old label, new label).

    ``before``: rotation and spaces of the round before.
    """
    d, spaces = len(v), list(spaces)
    shapes = [(s.k * (1 + d), d * d, (before[1][k].k + 1) * (s.k + 1) if before else 0) for k, s in enumerate(spaces)]

    def add(frames):
        totals = [np.zeros(sum(x)) for x in shapes]
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["features"]).astype(float)
            whole = x.T @ x
            for k, space in enumerate(spaces):
                at = _space_labels(x, v, space, outliers)
                members, total = at >= 0, totals[k]
                sums = np.zeros((space.k, 1 + d))
                np.add.at(sums, at[members], np.concatenate([np.ones((members.sum(), 1)), x[members]], axis=1))
                total[: shapes[k][0]] += sums.ravel()
                total[shapes[k][0] : shapes[k][0] + d * d] += (whole if members.all() else x[members].T @ x[members]).ravel()
                if before:
                    old = _space_labels(x, before[0], before[1][k], outliers)
                    width = space.k + 1
                    total[shapes[k][0] + d * d :] += np.bincount((old + 1) * width + at + 1, minlength=shapes[k][2])
        yield pd.DataFrame({"space": range(len(totals)), "sums": totals})

    rows = points.select("features").mapInPandas(add, "space int, sums array<double>")
    rows = rows.select("space", F.posexplode("sums").alias("pos", "x")).groupBy("space", "pos").agg(F.sum("x").alias("x")).groupBy("space").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    out = [None] * len(spaces)
    for r in rows.select("space", F.expr("transform(v, e -> e.x)").alias("v")).collect():  # model-sized
        k = r["space"]
        flat = np.array(r["v"])
        sums = flat[: shapes[k][0]].reshape(spaces[k].k, 1 + d)
        outer = flat[shapes[k][0] : shapes[k][0] + d * d].reshape(d, d)
        table = flat[shapes[k][0] + d * d :].reshape(-1, spaces[k].k + 1) if before else None
        out[k] = (sums[:, 0], sums[:, 1:], outer, table)
    return out


def _updated(space: Space, counts, sums, outer, n: int) -> Space:
    """Centres at the means, empty clusters gone, and the pooled scatter."""
    kept = counts > 0
    means = sums[kept] / counts[kept][:, None]
    return replace(space, centres=means, counts=counts[kept], scatter=outer - (means * counts[kept][:, None]).T @ means, outliers=int(round(n - counts.sum())))


def _same_partition(table: np.ndarray) -> bool:
    return ((table > 0).sum(0) <= 1).all() and ((table > 0).sum(1) <= 1).all()


def outlier_limit(space: Space, axes: np.ndarray, n: int, max_distance: float) -> float:
    """Squared distance beyond which coding a point alone is cheaper than as a member."""
    trace, m = float(np.trace(axes.T @ space.scatter @ axes)), space.dims
    if not m or trace <= 0 or n < 2:
        return math.inf
    cost = uniform_costs(m, max_distance) + math.log2(n) - math.log2(space.k)
    power = -(2 * math.log(2) * cost / m - 1 - math.log(2 * math.pi / (m * n)) - math.log(trace)) / (n - 1)
    return trace * (1 - (n - 1) / n * math.exp(power))


def dealt_columns(columns, negative: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The first ``negative`` columns, and the rest from the last one on."""
    return tuple(columns[:negative]), tuple(columns[negative:][::-1])


def rotated(v: np.ndarray, first: Space, second: Space, n: int, threshold: float = 0.0, mdl=None) -> tuple[np.ndarray, Space, Space]:
    """Turn two spaces against each other so that each gets the directions in which its clusters are tighter.

    ``mdl``: (max_distance, precision, outliers) where the number of dimensions
    that a noise space leaves is chosen by description length.
    """
    columns = (*first.columns, *second.columns)
    if not columns:
        return v, first, second
    axes = v[:, list(columns)]
    weigh = lambda s: s.scatter * (n / max(n - s.outliers, 1))
    difference = axes.T @ (weigh(first) - weigh(second)) @ axes
    values, vectors = np.linalg.eigh((difference + difference.T) / 2)
    out = v.copy()
    out[:, list(columns)] = axes @ vectors
    negative = int((values < (threshold if second.k == 1 and not mdl else 0)).sum())
    deal = lambda m: dealt_columns(columns, m)
    if second.k == 1 and mdl:
        best, costs = 0, math.inf
        for m in range(1, negative + 1):
            total = 0.0
            for s, own in zip((first, second), deal(m)):
                total += integer_costs(max(len(own), 1), True) + s.k * reference_vector_costs(len(own), mdl[0], mdl[1])
                total += common_costs(len(own), s.scatter, n - s.outliers, out[:, list(own)])
                total += s.outliers * uniform_costs(len(own), mdl[0]) if mdl[2] else 0.0
            if total >= costs:
                break
            best, costs = m, total
        negative = best
    a, b = deal(negative)
    return out, replace(first, columns=a), replace(second, columns=b)


def nr_kmeans(points: DataFrame, n_clusters, rotation: np.ndarray | None = None, columns=None, centres=None, mdl_for_noise: bool = False, outliers: bool = False, rounds: int = 300, threshold: float = THRESHOLD, max_distance: float | None = None, precision: float | None = None, seed: int = 0) -> NrModel:
    """k-means in several subspaces at once, which an orthogonal rotation keeps apart.

    ``n_clusters``: clusters of each subspace; at most one may be 1, the noise
    space.  Ends when the labels of all subspaces rest.
    """
    sizes = sorted(([n_clusters] if isinstance(n_clusters, int) else list(n_clusters)), reverse=True)
    row = points.select(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    n, d = row["n"], row["d"]
    if not n:
        raise ValueError("no points")
    if sizes.count(1) > 1 or min(sizes) < 1 or len(sizes) > d:
        raise ValueError("subspaces have at least one cluster each, one of them may be a noise space, and there are at most as many as dimensions")
    rng = np.random.default_rng(seed)
    v = random_rotation(d, rng) if rotation is None and d > 1 else np.eye(d) if rotation is None else np.asarray(rotation, float)
    if not is_orthogonal(v):
        raise ValueError("the rotation is not orthogonal")
    if columns is None:
        columns = [tuple(x.tolist()) for x in np.array_split(rng.permutation(d), len(sizes))]
    needs = mdl_for_noise or outliers
    if needs and max_distance is None:
        max_distance = max(float(geo.label_pair_sums(points.withColumn("label", F.lit(0))).first()["longest"]), 1e-9)
    if needs and precision is None:
        precision = smallest_gaps(points)
    spaces = []
    for s, (k, own) in enumerate(zip(sizes, columns)):
        if centres is not None:
            at = np.asarray(centres[s], float)
        elif own:
            at = _seed(turned(points, v[:, list(own)]), k, seed + 17 * s) @ v[:, list(own)].T
        else:
            at = _seed(points, k, seed + 17 * s)
        spaces.append(Space(tuple(own), at))
    before, done = None, 0
    for done in range(1, rounds + 1):
        found = _statistics(points, v, spaces, before)
        stable = before is not None and all(_same_partition(t) for *_, t in found)
        new = [_updated(s, *f[:3], n) for s, f in zip(spaces, found)]
        if outliers:
            new = [replace(s, limits=outlier_limit(s, v[:, list(s.columns)], n, max_distance)) for s in new]
            checked = _statistics(points, v, new, None, True)
            # a cluster that would be left without members keeps them
            new = [_updated(s, *f[:3], n) if (f[0] > 0).all() else replace(s, limits=math.inf) for s, f in zip(new, checked)]
        before, spaces = (v, tuple(spaces)), new
        if stable:
            break
        for i in range(len(spaces)):
            for j in range(i + 1, len(spaces)):
                mdl = (max_distance, precision, outliers) if mdl_for_noise else None
                v, spaces[i], spaces[j] = rotated(v, spaces[i], spaces[j], n, threshold, mdl)
        held = [s for s in spaces if s.columns]
        if len(held) < len(spaces):
            spaces, before = held, None
    return NrModel(v, tuple(spaces), n, done, max_distance, precision, outliers)


def best_nr_kmeans(points: DataFrame, n_clusters, repeats: int = 1, by_mdl: bool = False, seed: int = 0, **options) -> NrModel:
    """The run of least cost, or of least description length."""
    runs = [nr_kmeans(points, n_clusters, seed=seed + 1000 * r, **options) for r in range(max(1, repeats))]
    return min(runs, key=lambda m: m.mdl()[0] if by_mdl else m.cost())


def sub_kmeans(points: DataFrame, k: int = 8, repeats: int = 1, seed: int = 0, **options) -> NrModel:
    """One space with k clusters and one noise space."""
    d = points.select(F.max(F.size("features"))).first()[0]
    return best_nr_kmeans(points, [k, 1] if k > 1 and d > 1 else [k], repeats, seed=seed, **options)


@dataclass(frozen=True)
class LdaModel:
    axes: np.ndarray
    centres: np.ndarray
    error: float

    def transform(self, points: DataFrame) -> DataFrame:
        return turned(points, self.axes)

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        axes, centres = self.axes, self.centres

        @F.pandas_udf("int")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(_nearest(np.stack(features) @ axes, centres) if len(features) else [], dtype="int32")

        return points.withColumn(name, run("features"))


def lda_kmeans(points: DataFrame, k: int = 8, dims: int | None = None, rounds: int = 300, repeats: int = 1, seed: int = 0) -> LdaModel:
    """k-means in the space that separates its own clusters best, alternating until the labels rest."""
    d = points.select(F.max(F.size("features"))).first()[0]
    dims = min(d, dims or max(1, k - 1))
    n, mean, total = scatter(points)
    best = None
    for r in range(max(1, repeats)):
        axes = np.linalg.eigh(total)[1][:, ::-1][:, :dims]
        before = None
        for _ in range(rounds):
            with kept_for_passes(turned(points, axes)) as along:  # each round of k-means reads them
                own = kmeans(along, k, seed + r)
            # labels as a space of the whole data: nearest centres along the axes
            q, _ = np.linalg.qr(np.concatenate([axes, np.eye(d)], axis=1))
            space = Space(tuple(range(dims)), own.centres @ np.linalg.pinv(axes))
            frame = np.concatenate([axes, q[:, dims:]], axis=1)
            counts, sums, outer, table = _statistics(points, frame, [space], before and (before[0], [before[1]]))[0]
            kept = _updated(space, counts, sums, outer, n)
            error = float(np.trace(axes.T @ kept.scatter @ axes))
            if best is None or error < best.error:
                best = LdaModel(axes, kept.centres @ axes, error)
            if table is not None and _same_partition(table):
                break
            before = (frame, space)
            values, vectors = generalised_eigen(total - kept.scatter, kept.scatter + 1e-9 * np.eye(d) * max(np.trace(total) / d, 1e-12))
            axes = vectors[:, :dims] / np.maximum(np.linalg.norm(vectors[:, :dims], axis=0), 1e-300)
    return best


def principal_axes(points: DataFrame, share: float | None = None, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes by falling variance and these variances; as many as explain ``share`` of all, or ``dims``."""
    n, mean, s = scatter(points)
    values, vectors = np.linalg.eigh(s / max(n - 1, 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    # signs are fixed by the largest entry
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    if dims is None:
        dims = len(values) if share is None else int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12) + 1)
    return mean, vectors[:, :dims], values[:dims]


@dataclass(frozen=True)
class OrthogonalModel:
    """k-means models in turn, each on what the ones before leave: (mean, axes or None, centres) of each step."""

    mean: np.ndarray
    steps: tuple
    per_cluster: bool

    def residual(self, x: np.ndarray, upto: int) -> np.ndarray:
        """Points after the first ``upto`` steps have taken their part."""
        x = x - self.mean
        for shift, axes, centres, whole in self.steps[:upto]:
            x = self._rest(x, _nearest((x - shift) @ axes, centres), whole)
        return x

    def _rest(self, x, at, centres):
        if self.per_cluster:
            c = centres[at]
            size = np.maximum((c**2).sum(1, keepdims=True), 1e-300)
            return x - (x * c).sum(1, keepdims=True) / size * c
        spread = centres - centres.mean(0)
        u, s, vt = np.linalg.svd(spread, full_matrices=False)
        span = vt[s > 1e-10 * max(s.max(), 1e-300)]
        return x - x @ span.T @ span

    def labels(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k, (shift, axes, centres, _) in enumerate(self.steps):
            out.append(_nearest((self.residual(x, k) - shift) @ axes, centres))
        return np.stack(out, axis=1)

    def predict(self, points: DataFrame, name: str = "labels") -> DataFrame:
        @F.pandas_udf("array<int>")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(list(self.labels(np.stack(features)).astype("int32")) if len(features) else [], dtype=object)

        return points.withColumn(name, run("features"))

    def transform(self, points: DataFrame, s: int) -> DataFrame:
        """The data as the s-th clustering sees it."""

        @F.pandas_udf("array<double>")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(list(self.residual(np.stack(features), s)) if len(features) else [], dtype=object)

        return points.withColumn("features", run("features"))


def _orthogonal(points: DataFrame, n_clusters, share: float, per_cluster: bool, seed: int) -> OrthogonalModel:
    _, mean, _ = scatter(points)
    model = OrthogonalModel(mean, (), per_cluster)
    for s, k in enumerate([n_clusters] if isinstance(n_clusters, int) else n_clusters):
        rest = model.transform(points, s)
        shift, axes, _ = principal_axes(rest, share)
        own = kmeans(_shifted(rest, shift, axes), k, seed + s)
        whole = own.centres @ axes.T + shift
        model = replace(model, steps=(*model.steps, (shift, axes, own.centres, whole)))
    return model


def _shifted(points: DataFrame, shift: np.ndarray, axes: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(features: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(features) - shift) @ axes) if len(features) else [], dtype=object)

    return points.withColumn("features", run("features"))


def orthogonal_clustering(points: DataFrame, n_clusters=(3, 3), share: float = 0.9, seed: int = 0) -> OrthogonalModel:
    """Each clustering sees what is orthogonal to a point's own centre of the one before."""
    return _orthogonal(points, n_clusters, share, True, seed)


def clustering_in_orthogonal_spaces(points: DataFrame, n_clusters=(3, 3), share: float = 0.9, seed: int = 0) -> OrthogonalModel:
    """Each clustering sees the space orthogonal to all centres of the one before."""
    return _orthogonal(points, n_clusters, share, False, seed)


def split_largest(v: np.ndarray, space: Space, variances: np.ndarray) -> np.ndarray:
    """Centres with that of the largest variance replaced by two, pushed apart along the space's widest axis."""
    worst = int(variances.argmax())
    axes = v[:, list(space.columns)]
    values, vectors = np.linalg.eigh(axes.T @ space.scatter @ axes)
    push = axes @ vectors[:, -1] * math.sqrt(max(variances[worst], 0) / max(space.counts[worst], 1))
    kept = [c for k, c in enumerate(space.centres) if k != worst]
    return np.array([*kept, space.centres[worst] + push, space.centres[worst] - push])


def closest_centres(centres: np.ndarray) -> tuple[int, int]:
    d = ((centres[:, None] - centres[None]) ** 2).sum(2)
    d[np.tril_indices(len(d))] = np.inf
    return tuple(int(x) for x in np.unravel_index(d.argmin(), d.shape))


def merge_nearest(centres: np.ndarray) -> np.ndarray:
    """Centres with the two closest replaced by their midpoint."""
    a, b = closest_centres(centres)
    kept = [c for k, c in enumerate(centres) if k not in (a, b)]
    return np.array([*kept, (centres[a] + centres[b]) / 2])


@dataclass(frozen=True)
class AutoNr:
    model: NrModel
    #: (operation, whole space, bits, accepted) of every trial, in order.
    progress: tuple


def _variances(space: Space) -> np.ndarray:
    return np.full(space.k, np.trace(space.scatter) / max(space.counts.sum(), 1)) * space.counts


def auto_nr(points: DataFrame, repeats: int = 3, outliers: bool = False, max_spaces: int | None = None, max_clusters: int = 32, max_distance: float | None = None, precision: float | None = None, similarity: float = 1e-5, seed: int = 0) -> AutoNr:
    """Number of subspaces and of their clusters by description length.

    From one noise space on, spaces are split (the noise space into a cluster
    space and the rest, a cluster space in two) or two of them merged; a trial
    in the subspace alone comes first, and what it finds is refined in the
    whole space.  A step stays if the whole description gets shorter.
    """
    d = points.select(F.max(F.size("features"))).first()[0]
    if d < 2:
        raise ValueError("needs two features at least")
    max_distance = max_distance or max(float(geo.label_pair_sums(points.withColumn("label", F.lit(0))).first()["longest"]), 1e-9)
    precision = precision or smallest_gaps(points)
    max_spaces = min(d, max_spaces or d)
    common = {"outliers": outliers, "mdl_for_noise": True, "max_distance": max_distance, "precision": precision}
    best = nr_kmeans(points, [1], rotation=np.eye(d), columns=[tuple(range(d))], seed=seed, **common)
    log = [("start", True, best.mdl()[0], True)]

    def whole(operation: str, spaces: list[tuple], v: np.ndarray) -> bool:
        """Refine (columns, centres) of all spaces in the whole space; noise spaces become one."""
        nonlocal best
        noise = tuple(c for own, at in spaces if len(at) == 1 for c in own)
        held = sorted(((own, at) for own, at in spaces if len(at) > 1 and own), key=lambda s: -len(s[1]))
        if noise:
            held.append((noise, [best_mean]))
        found = nr_kmeans(points, [len(at) for _, at in held], v, [own for own, _ in held], [np.asarray(at) for _, at in held], seed=seed, **common)
        bits = found.mdl()[0]
        better = bits < best.mdl()[0] * (1 - similarity)
        log.append((operation, True, bits, better))
        if better:
            best = found
        return better

    best_mean = scatter(points)[1]

    def inner(s: int, sizes: list[int], centres=None, start=None) -> NrModel:
        """Trial within one subspace."""
        own = turned(points, best.axes(s))
        options = dict(common)
        if start is not None:
            return nr_kmeans(own, sizes, start.rotation, [x.columns for x in start.spaces], centres, seed=seed, **options)
        return best_nr_kmeans(own, sizes, repeats, True, seed, **options)

    def lift(s: int, found: NrModel) -> tuple[np.ndarray, list[tuple]]:
        """Spaces of the whole space when subspace s is replaced by those found in it."""
        v, columns = best.rotation.copy(), best.spaces[s].columns
        axes = best.axes(s)
        v[:, list(columns)] = axes @ found.rotation
        new = [(tuple(columns[c] for c in x.columns), x.centres @ axes.T) for x in found.spaces]
        return v, [(x.columns, x.centres) for k, x in enumerate(best.spaces) if k != s] + new

    changed = True
    while changed:
        changed = False
        for s in sorted(range(len(best.spaces)), key=lambda k: -best.mdl()[2][k]):
            space = best.spaces[s]
            if space.dims < 1:
                continue
            if space.k == 1:
                last, k = None, 2
                while k <= max_clusters and k <= best.n:
                    sizes = [k, 1] if space.dims > 1 else [k]
                    if last is None:
                        found = inner(s, sizes)
                    else:
                        first = last.spaces[0]
                        more = split_largest(last.rotation, first, _variances(first))
                        found = inner(s, [len(more), *[x.k for x in last.spaces[1:]]], [more, *[x.centres for x in last.spaces[1:]]], last)
                    bits = found.mdl()[0]
                    log.append(("split noise space", False, bits, last is None or bits < last.mdl()[0]))
                    if last is not None and bits >= last.mdl()[0]:
                        break
                    last, k = found, k + 1
                if last is not None and len(best.spaces) < max_spaces + 1:
                    v, spaces = lift(s, last)
                    changed = whole("split noise space", spaces, v)
            elif space.dims > 1 and len(best.spaces) < max_spaces:
                last, sizes = None, [space.k, space.k]
                while min(sizes) >= 1 and sizes != [1, 1]:
                    found = inner(s, sizes)
                    bits = found.mdl()[0]
                    log.append(("split cluster space", False, bits, last is None or bits < last.mdl()[0]))
                    if last is not None and bits >= last.mdl()[0]:
                        if sizes[0] == sizes[1] and sizes[0] > 1:
                            sizes = [sizes[0] + 1, sizes[1]]
                            sizes = [max(sizes), min(sizes)]
                            if sizes == [space.k, space.k]:
                                break
                            found = inner(s, sizes)
                            last = found if found.mdl()[0] < last.mdl()[0] else last
                        break
                    last, sizes = found, [sizes[0] - 1, sizes[1] - 1]
                if last is not None and len(last.spaces) > 1:
                    v, spaces = lift(s, last)
                    changed = whole("split cluster space", spaces, v)
            if changed:
                break
        if changed:
            continue
        for a, b in itertools.combinations([k for k, x in enumerate(best.spaces) if x.k > 1], 2):
            x, y = best.spaces[a], best.spaces[b]
            if x.k * y.k > 4 * max_clusters:
                continue
            pa, pb = best.axes(a), best.axes(b)
            centres = np.array([p @ pa @ pa.T + q @ pb @ pb.T for p in x.centres for q in y.centres])
            columns, rest = (*x.columns, *y.columns), [(s.columns, s.centres) for k, s in enumerate(best.spaces) if k not in (a, b)]
            while len(centres) >= max(x.k, y.k):
                if whole("merge spaces", [*rest, (columns, centres)], best.rotation):
                    changed = True
                    break
                if len(centres) < 3:
                    break
                centres = merge_nearest(centres)
            if changed:
                break
    return AutoNr(best, tuple(log))


def mdl_progress(spark, found: AutoNr) -> DataFrame:
    """(step, operation, whole_space, bits, accepted) of the search."""
    return spark.createDataFrame([(k, *x) for k, x in enumerate(found.progress)], "step int, operation string, whole_space boolean, bits double, accepted boolean")

