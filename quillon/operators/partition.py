"""Partitioning estimators on (id, features) tables.

A model is k centres of d numbers, held by the driver; each round reads the
points once, sums the residuals of each cluster within a task in numpy and adds
the sums of all tasks by a Spark aggregation of (cluster, side, position), so
neither the driver nor a task ever holds points.  Splitting estimators try to
split all clusters in the same round.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that may seed the first centres (those of the smallest hashes).
INIT_ROWS = 10_000
#: Distances that a task holds at once.
CELLS = 1 << 22


@dataclass(frozen=True)
class Model:
    centres: np.ndarray
    inertia: float

    @property
    def k(self) -> int:
        return len(self.centres)

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        """Points with the number of their nearest centre, ties to the smallest."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(features: pd.Series) -> pd.Series:
            return pd.Series(_nearest(np.stack(features), centres) if len(features) else [], dtype="int32")

        return points.withColumn(name, nearest("features"))


@contextmanager
def held(points: DataFrame):
    """Points kept for the passes of a fit, spilling to disk; what an executor loses is read again."""
    kept = points.select("id", F.col("features").cast("array<double>").alias("features")).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def counted(points: DataFrame):
    """Distinct points (features, weight), kept for the passes of a fit; equal points are one row with their number."""
    rows = points.select(F.col("features").cast("array<double>").alias("features")).groupBy("features").agg(F.count("*").alias("weight"))
    kept = rows.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres**2).sum(1) - 2 * x @ centres.T)).argmin(1)


def _moments(points: DataFrame, centres: np.ndarray, children: np.ndarray | None = None):
    """n (k, 2), sums and sums of squares (k, 2, d) of residuals to centres or, given them, to each centre's two children.

    A column ``weight``, where there is one, tells how often a point counts.
    """
    k, d = centres.shape
    weighted = "weight" in points.columns

    def add(batches):
        total = np.zeros((k * 2, 1 + 2 * d))
        for batch in batches:
            points_of = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            weights = batch.column("weight").to_numpy(zero_copy_only=False).astype(float) if weighted else np.ones(len(points_of))
            parts = len(points_of) * k // CELLS + 1
            for x, w in zip(np.array_split(points_of, parts), np.array_split(weights, parts)):
                at = _nearest(x, centres) * 2
                base = centres[at // 2]
                if children is not None:
                    apart = children[:, 1] - children[:, 0]
                    middle = (children[:, 1] + children[:, 0]) / 2
                    at = at + (((x - middle[at // 2]) * apart[at // 2]).sum(1) > 0)
                    base = children.reshape(-1, d)[at]
                r = x - base
                total[:, 0] += np.bincount(at, w, 2 * k)
                for j in range(d):
                    total[:, 1 + j] += np.bincount(at, r[:, j] * w, 2 * k)
                    total[:, 1 + d + j] += np.bincount(at, r[:, j] ** 2 * w, 2 * k)
        used = np.flatnonzero(total[:, 0])
        if len(used):
            yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int32()), "sums": pa.array(list(total[used]), pa.list_(pa.float64()))})

    rows = points.select(F.col("features").cast("array<double>").alias("features"), *(["weight"] if weighted else [])).mapInArrow(add, "at int, sums array<double>")
    rows = rows.select("at", F.posexplode("sums").alias("pos", "x")).groupBy("at", "pos").agg(F.sum("x").alias("x"))
    out = np.zeros((k * 2, 1 + 2 * d))
    for row in rows.collect():  # 2k(2d + 1) numbers at most
        out[row["at"], row["pos"]] = row["x"]
    out = out.reshape(k, 2, -1)
    return out[:, :, 0], out[:, :, 1 : d + 1], out[:, :, d + 1 :]


def _seed(points: DataFrame, k: int, seed: int, rows: int = INIT_ROWS) -> np.ndarray:
    """k-means++ over at most ``rows`` points."""
    held = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows).select("features").toPandas()
    if not len(held):
        raise ValueError("no points")
    x = np.stack(held["features"]).astype(float)
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    near = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        total = near.sum()
        tries = rng.choice(len(x), 2 + int(math.log(k)), p=near / total if total else None)
        left = [np.minimum(near, ((x - x[t]) ** 2).sum(1)) for t in tries]
        best = int(np.argmin([v.sum() for v in left]))
        chosen.append(x[tries[best]])
        near = left[best]
    return np.array(chosen)


def lloyd(points: DataFrame, centres: np.ndarray, rounds: int = 100, tol: float = 1e-4) -> Model:
    """Move centres to the means of their points until their squared steps add up to ``tol`` times the mean squared distance over the dimensions; a centre without points stays."""
    inertia = math.inf
    for _ in range(rounds):
        n, r, q = (m[:, 0] for m in _moments(points, centres))
        inertia = float((q.sum(1) - (r**2).sum(1) / np.maximum(n, 1)).sum())
        step = r / np.maximum(n, 1)[:, None]
        centres = centres + step
        if (step**2).sum() <= tol * max(q.sum() / max(n.sum(), 1) / centres.shape[1], 1e-300):
            break
    return Model(centres, inertia)


def kmeans(points: DataFrame, k: int, seed: int = 0, rounds: int = 100, init: np.ndarray | None = None) -> Model:
    return lloyd(points, _seed(points, k, seed) if init is None else np.asarray(init, float), rounds)


def _split_all(points: DataFrame, centres: np.ndarray, rounds: int = 10):
    """Two children for every centre, moved by 2-means within each cluster; then n, their SSE, and the parents' SSE."""
    n, r, q = (m[:, 0] for m in _moments(points, centres))
    n1 = np.maximum(n, 1)
    variance = q / n1[:, None] - (r / n1[:, None]) ** 2
    parent_sse = (q.sum(1) - (r**2).sum(1) / n1).copy()
    step = np.zeros_like(centres)
    axis = variance.argmax(1)
    step[np.arange(len(centres)), axis] = np.sqrt(np.maximum(variance[np.arange(len(centres)), axis], 0))
    children = np.stack([centres - step, centres + step], axis=1)
    for _ in range(rounds):
        n, r, q = _moments(points, centres, children)
        move = r / np.maximum(n, 1)[:, :, None]
        children = children + move
        if (move**2).max() < 1e-9:
            break
    sse = q.sum(2) - (r**2).sum(2) / np.maximum(n, 1)
    return children, n, sse, parent_sse


def bic(n: np.ndarray, sse: float, d: int) -> float:
    """Schwarz criterion of spherical clusters of a common variance."""
    n = np.asarray(n, float)
    total, k = n.sum(), len(n)
    if total <= k:
        return -math.inf
    variance = max(sse / (total - k), 1e-300)
    likelihood = n * (np.log(n) - math.log(total) - 0.5 * math.log(2 * math.pi) - d / 2 * math.log(variance)) - (n - k) / 2
    return float(likelihood.sum() - k * (d + 1) * 0.5 * math.log(total))


def _grow(points: DataFrame, start: Model, max_k: int | None, verdict, score=None) -> Model:
    """Split clusters while ``verdict(children, n, sse, parent_sse)`` marks any, the most populous first up to max_k.

    ``score(model)``: where given, the model of the highest score over all rounds is kept.
    """
    model = best = start
    top = score(start) if score else 0.0
    while max_k is None or model.k < max_k:
        children, n, sse, parent = _split_all(points, model.centres)
        marked = verdict(model.centres, children, n, sse, parent) & (n.min(1) > 0)
        order = [c for c in np.argsort(-n.sum(1), kind="stable") if marked[c]][: None if max_k is None else max_k - model.k]
        if not order:
            break
        kept = [model.centres[c] for c in range(model.k) if c not in set(order)]
        model = lloyd(points, np.array(kept + [x for c in order for x in children[c]]))
        if score and (now := score(model)) > top:
            best, top = model, now
    return best if score else model


def global_bic(points: DataFrame, model: Model) -> float:
    """Schwarz criterion of all clusters of a model; one pass."""
    n, r, q = (m[:, 0] for m in _moments(points, model.centres))
    held = n > 0
    sse = float((q.sum(1) - (r**2).sum(1) / np.maximum(n, 1)).sum())
    return bic(n[held], sse, model.centres.shape[1])


def merge_by_bic(points: DataFrame, model: Model) -> Model:
    """Clusters merged with the partner whose union raises the criterion most, small ones first, each at most once.

    Sums of a union follow from those of its parts, so one pass serves all pairs.
    """
    n, r, q = (m[:, 0] for m in _moments(points, model.centres))
    d = model.centres.shape[1]
    means = model.centres + r / np.maximum(n, 1)[:, None]
    sse = q.sum(1) - (r**2).sum(1) / np.maximum(n, 1)
    free, out = {c for c in range(model.k) if n[c] > 0}, []
    for a in sorted(free, key=lambda c: (n[c], c)):
        if a not in free:
            continue
        free.discard(a)
        gains = []
        for b in free:
            apart = bic(np.array([n[a], n[b]]), sse[a] + sse[b], d)
            joint = sse[a] + sse[b] + n[a] * n[b] / (n[a] + n[b]) * float(((means[a] - means[b]) ** 2).sum())
            gains.append((bic(np.array([n[a] + n[b]]), joint, d) - apart, -b))
        gain, b = max(gains, default=(-math.inf, 0))
        if gain > 0:
            free.discard(-b)
            out.append((n[a] * means[a] + n[-b] * means[-b]) / (n[a] + n[-b]))
        else:
            out.append(means[a])
    return lloyd(points, np.array(out)) if len(out) < model.k else model


def xmeans(points: DataFrame, k: int = 2, max_k: int | None = None, seed: int = 0, check_global_score: bool = True, allow_merging: bool = False) -> Model:
    """k-means whose clusters are split while the Schwarz criterion of two children beats that of the parent.

    ``check_global_score``: of the models of all rounds the one with the highest
    criterion over all clusters is kept.  ``allow_merging``: pairs whose union
    raises the criterion are merged in the end.  Halving a cluster that is even
    in two dimensions just balances the criterion, so a square grid of blobs
    needs k of 2 or more to start.
    """

    def verdict(centres, children, n, sse, parent):
        d = centres.shape[1]
        return np.array([n[c].min() > 0 and bic(n[c].sum(keepdims=True), parent[c], d) < bic(n[c], sse[c].sum(), d) for c in range(len(centres))])

    with held(points) as points:
        model = _grow(points, kmeans(points, k, seed), max_k, verdict, (lambda m: global_bic(points, m)) if check_global_score else None)
        return merge_by_bic(points, model) if allow_merging else model


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """log of the normal distribution function, by the continued fraction of its tail beyond 5 and a table of its integral inside."""
    grid = np.linspace(-5, 5, 20_001)
    density = np.exp(-(grid**2) / 2) / math.sqrt(2 * math.pi)
    # Simpson's rule over cells of two steps, and their middles by symmetry of the error
    cells = np.concatenate(([0.0], np.cumsum((density[:-1] + density[1:]) / 2 * np.diff(grid) - np.diff(grid) ** 3 / 12 * ((grid[:-1] + grid[1:]) ** 2 / 4 - 1) * (density[:-1] + density[1:]) / 2)))
    inner = cells + 0.5 * math.erfc(5 / math.sqrt(2))
    x = np.maximum(np.abs(z), 5.0)
    fraction = x
    for k in range(40, 0, -1):
        fraction = x + k / fraction
    tail = -(x**2) / 2 - 0.5 * math.log(2 * math.pi) - np.log(fraction)  # log P(Z > x)
    middle = np.log(np.interp(np.clip(z, -5, 5), grid, inner))
    return np.where(z < -5, tail, np.where(z > 5, -np.exp(tail), middle))


def anderson_darling(values: DataFrame) -> DataFrame:
    """(group, n, a2) of (group, x) or (group, x, weight): the statistic for normality of unknown mean and variance, corrected for n.

    A row of weight w stands for w equal values, whose ranks add up in one term
    each way.  Ranks come from those within narrow bands of z and the bands' running
    counts, so no task sorts a whole group.  A group of one value has a2 null.
    """

    @F.pandas_udf("double")
    def log_cdf(z: pd.Series) -> pd.Series:
        return pd.Series(log_normal_cdf(z.to_numpy(float)))

    if "weight" not in values.columns:
        values = values.withColumn("weight", F.lit(1).cast("long"))
    values = values.where("x is not null")
    means = values.groupBy("group").agg(F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("m"))
    spread = F.sum(F.col("weight") * (F.col("x") - F.col("m")) ** 2)
    moments = values.join(F.broadcast(means), "group").groupBy("group").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.when(F.first("n") > 1, F.sqrt(spread / F.greatest(F.first("n") - 1, F.lit(1)))).alias("s"))
    z = values.join(F.broadcast(moments), "group").where("s > 0").withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))
    z = z.withColumn("band", F.greatest(F.lit(-4096), F.least(F.lit(4096), F.floor(F.col("z") * 256))))
    bands = z.groupBy("group", "band").agg(F.sum("weight").alias("c"))
    before = bands.withColumn("before", F.sum("c").over(Window.partitionBy("group").orderBy("band")) - F.col("c")).drop("c")
    upto = Window.partitionBy("group", "band").orderBy("z").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = z.withColumn("i", F.sum("weight").over(upto)).join(before, ["group", "band"])
    w = F.col("weight").cast("double")
    under = F.col("i") + F.col("before") - w  # values that come first
    # sums of 2 i - 1 and of 2 (n - i) + 1 over the ranks i of a row
    term = w * (2 * under + w) * log_cdf("z") + w * (2 * (F.col("n") - under) - w) * log_cdf(-F.col("z"))
    a2 = ranked.groupBy("group").agg(F.first("n").alias("n"), F.sum(term).alias("t"))
    a2 = a2.select("group", ((-F.col("n") - F.col("t") / F.col("n")) * (1 + 0.75 / F.col("n") + 2.25 / F.col("n") ** 2)).alias("a2"))
    return moments.select("group", "n").join(a2, "group", "left")


def anderson_p_value(a2: float) -> float:
    """Published approximation (D'Agostino and Stephens, 1986) in four branches; 0 where its last parabola turns up again.

    Its coefficients are fixed values; the last branch has the published sign of the square term.
    """
    if a2 > 153:
        return 0.0
    if a2 >= 0.6:
        return math.exp(1.2937 - 5.709 * a2 + 0.0186 * a2 * a2)
    if a2 > 0.34:
        return math.exp(0.9177 - 4.279 * a2 - 1.38 * a2 * a2)
    if a2 > 0.2:
        return 1 - math.exp(-8.318 + 42.796 * a2 - 59.938 * a2 * a2)
    return 1 - math.exp(-13.436 + 101.14 * a2 - 223.73 * a2 * a2)


def gmeans(points: DataFrame, k: int = 1, max_k: int | None = None, significance: float = 0.0001, seed: int = 0) -> Model:
    """k-means whose clusters are split while their points, on the line through two children, are not normal.

    Equal points are counted once and then are one row, so that the rounds grow with the distinct points.
    """

    def verdict(centres, children, n, sse, parent):
        axes = children[:, 1] - children[:, 0]

        @F.pandas_udf("group int, x double")
        def project(features: pd.Series) -> pd.DataFrame:
            x = np.stack(features)
            at = _nearest(x, centres)
            return pd.DataFrame({"group": at.astype("int32"), "x": (x * axes[at]).sum(1)})

        values = distinct.select(project("features").alias("p"), "weight").select("p.group", "p.x", "weight")
        marked = np.zeros(len(centres), bool)
        for row in anderson_darling(values).collect():  # k rows
            marked[row["group"]] = row["a2"] is not None and anderson_p_value(row["a2"]) < significance
        return marked

    with counted(points) as distinct:
        return _grow(distinct, lloyd(distinct, _seed(points, k, seed)), max_k, verdict)


def reference_points(points: DataFrame, b: int, seed: int = 0) -> DataFrame:
    """As many points, uniform in the bounding box; drawn from hashes of ids, so a retried task draws the same."""
    long = points.select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    box = sorted((r["dim"], r["lo"], r["hi"]) for r in long.collect())  # d rows
    unit = lambda dim: F.pmod(F.xxhash64("id", F.lit(dim), F.lit(b), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return points.select("id", F.array(*[F.lit(lo) + unit(dim) * (hi - lo) for dim, lo, hi in box]).alias("features"))


def gap_statistic(points: DataFrame, max_k: int = 10, n_refs: int = 5, seed: int = 0) -> tuple[int, list[tuple[int, float, float]]]:
    """The first k whose gap reaches that of k + 1 less its error, and (k, gap, error) of each k looked at."""
    refs = [reference_points(points, b, seed) for b in range(n_refs)]
    found: list[tuple[int, float, float]] = []
    for k in range(1, max_k + 1):
        own = math.log(max(kmeans(points, k, seed).inertia, 1e-300))
        random = [math.log(max(kmeans(x, k, seed).inertia, 1e-300)) for x in refs]
        found.append((k, float(np.mean(random) - own), float(np.std(random) * math.sqrt(1 + 1 / n_refs))))
        if k > 1 and found[-2][1] >= found[-1][1] - found[-1][2]:
            return k - 1, found
    return max_k, found


def scatter(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and scatter matrix; d x d partial sums per task."""

    def add(frames):
        n, s, q = 0, 0.0, 0.0
        for frame in frames:
            if len(frame):
                x = np.stack(frame["features"]).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            yield pd.DataFrame({"sums": [np.concatenate([[n], s, q.ravel()])]})

    rows = points.select("features").mapInPandas(add, "sums array<double>").select(F.posexplode("sums").alias("pos", "x"))
    flat = np.array([x for _, x in sorted((r["pos"], r["x"]) for r in rows.groupBy("pos").agg(F.sum("x").alias("x")).collect())])
    d = int((math.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, s, q = flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d)
    return int(n), s / n, q - np.outer(s, s) / n


def scatter_by_label(points: DataFrame) -> DataFrame:
    """(label, i, j, s): upper triangles, over all dimensions, of the scatter matrix of each label; d x d partial sums per task."""

    def add(frames):
        held = {}
        for frame in frames:
            for label, part in frame.groupby("label", dropna=False):
                label = None if pd.isna(label) else int(label)
                x = np.stack(part["features"]).astype(float)
                n, s, q = held.get(label, (0, 0.0, 0.0))
                held[label] = n + len(x), s + x.sum(0), q + x.T @ x
        for label, (n, s, q) in held.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"label": pd.array([label] * len(i), dtype="Int32"), "i": i, "j": j, "n": n, "a": s[i], "b": s[j], "q": q[i, j]})

    rows = points.select("label", "features").mapInPandas(add, "label int, i int, j int, n long, a double, b double, q double")
    return rows.groupBy("label", "i", "j").agg((F.sum("q") - F.sum("a") * F.sum("b") / F.sum("n")).alias("s"))
