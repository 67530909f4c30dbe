"""Gaussian mixtures by EM, and the number of components by projections (PG-means)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.partition import kmeans, scatter
from quillon.operators.subspace import turned


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    #: Mean log-likelihood of a point.
    score: float = -math.inf

    @property
    def k(self) -> int:
        return len(self.weights)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log of weight times density, points by components."""
        d = x.shape[1]
        out = np.empty((len(x), self.k))
        for c in range(self.k):
            low = np.linalg.cholesky(self.covariances[c])
            z = np.linalg.solve(low, (x - self.means[c]).T)
            out[:, c] = math.log(max(self.weights[c], 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + (z**2).sum(0)) - np.log(np.diag(low)).sum()
        return out

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        joint = self.log_joint(x)
        top = joint.max(1)
        return top + np.log(np.exp(joint - top[:, None]).sum(1))

    def predict(self, points: DataFrame, name: str = "cluster") -> DataFrame:
        """Points with the number of their likeliest component."""

        @F.pandas_udf("int")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(self.log_joint(np.stack(features)).argmax(1) if len(features) else [], dtype="int32")

        return points.withColumn(name, run("features"))

    def scored(self, points: DataFrame, name: str = "log_likelihood") -> DataFrame:
        @F.pandas_udf("double")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(self.log_likelihood(np.stack(features)) if len(features) else [], dtype=float)

        return points.withColumn(name, run("features"))

    def projected(self, axis: np.ndarray) -> Mixture:
        """The one-dimensional mixture along an axis."""
        return Mixture(self.weights, (self.means @ axis)[:, None], np.einsum("i,kij,j->k", axis, self.covariances, axis)[:, None, None])

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        of = rng.choice(self.k, n, p=self.weights / self.weights.sum())
        out = np.empty((n, self.means.shape[1]))
        for c in range(self.k):
            own = of == c
            out[own] = self.means[c] + rng.normal(size=(own.sum(), self.means.shape[1])) @ np.linalg.cholesky(self.covariances[c]).T
        return out


def _step(points: DataFrame, model: Mixture):
    """Sum of log-likelihoods, responsibilities, weighted sums and outer products; one pass."""
    k, d = model.means.shape
    size = 1 + d + d * d

    def add(frames):
        total = np.zeros(1 + k * size)
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["features"]).astype(float)
            joint = model.log_joint(x)
            top = joint.max(1)
            like = top + np.log(np.exp(joint - top[:, None]).sum(1))
            r = np.exp(joint - like[:, None])
            total[0] += like.sum()
            for c in range(k):
                z = x - model.means[c]
                part = total[1 + c * size : 1 + (c + 1) * size]
                part[0] += r[:, c].sum()
                part[1 : 1 + d] += r[:, c] @ z
                part[1 + d :] += ((z * r[:, c, None]).T @ z).ravel()
        yield pd.DataFrame({"sums": [total]})

    rows = points.select("features").mapInPandas(add, "sums array<double>").select(F.posexplode("sums").alias("pos", "x"))
    flat = np.zeros(1 + k * size)
    for r in rows.groupBy("pos").agg(F.sum("x").alias("x")).collect():  # model-sized
        flat[r["pos"]] = r["x"]
    parts = flat[1:].reshape(k, size)
    return flat[0], parts[:, 0], parts[:, 1 : 1 + d], parts[:, 1 + d :].reshape(k, d, d)


def fit_mixture(points: DataFrame, means: np.ndarray, kind: str = "full", rounds: int = 100, tol: float = 1e-4, ridge: float = 1e-6) -> Mixture:
    """EM from given means; starts with the covariance of all points and equal weights."""
    if kind not in ("full", "diag"):
        raise ValueError("kind is full or diag")
    n, _, s = scatter(points)
    d, k = len(s), len(means)
    shape = (lambda c: c) if kind == "full" else (lambda c: np.diag(np.diag(c)))
    start = shape(s / max(n, 1)) + ridge * np.eye(d)
    model = Mixture(np.full(k, 1 / k), np.asarray(means, float), np.repeat(start[None], k, 0))
    before = -math.inf
    for _ in range(rounds):
        like, r, sums, outer = _step(points, model)
        model = replace(model, score=like / n)
        if model.score - before < tol:
            break
        before = model.score
        r1 = np.maximum(r, 1e-10)
        shift = sums / r1[:, None]
        cov = outer / r1[:, None, None] - np.einsum("ki,kj->kij", shift, shift)
        model = Mixture(r / n, model.means + shift, np.array([shape(c) + ridge * np.eye(d) for c in cov]), model.score)
    return model


def mixture(points: DataFrame, k: int, kind: str = "full", repeats: int = 1, seed: int = 0) -> Mixture:
    """The likeliest of some fits that start from k-means centres."""
    if k == 1:
        return fit_mixture(points, scatter(points)[1][None], kind)
    return max((fit_mixture(points, kmeans(points, k, seed + r).centres, kind) for r in range(max(1, repeats))), key=lambda m: m.score)


def ks_statistic(values: DataFrame, sample: np.ndarray) -> tuple[float, int]:
    """Largest distance between the distribution of a column x and that of a drawn sample, and the number of values.

    Only how many values lie between neighbours of the sample is counted; the
    distance at each sample point follows from the counts, and within a gap it
    is largest at its ends.
    """
    marks = np.sort(sample)

    @F.pandas_udf("long")
    def gap(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, x.to_numpy(), side="left") * 2 + np.isin(x.to_numpy(), marks))

    # 2 g: in the open gap before mark g; 2 g + 1: equal to mark g
    counts = np.zeros(2 * len(marks) + 2)
    for r in values.groupBy(gap("x").alias("gap")).agg(F.count("*").alias("n")).collect():  # twice the sample at most
        counts[r["gap"]] = r["n"]
    n = counts.sum()
    done = np.cumsum(counts) / max(n, 1)
    upto = np.searchsorted(marks, marks, side="right") / len(marks)
    before = np.searchsorted(marks, marks, side="left") / len(marks)
    at = 2 * np.searchsorted(marks, marks, side="left")
    return float(max(np.abs(done[at + 1] - upto).max(), np.abs(done[at] - before).max())), int(n)


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sample probability of a larger distance."""
    e = math.sqrt(n * m / (n + m))
    z = (e + 0.12 + 0.11 / e) * statistic
    if z < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101))))


@dataclass(frozen=True)
class PgModel:
    mixture: Mixture
    rounds: int


def pg_means(points: DataFrame, significance: float = 0.001, projections: int | None = None, samples: int | None = None, new_centres: int = 10, random_share: float = 0.5, k: int = 1, max_k: int | None = None, seed: int = 0) -> PgModel:
    """Mixtures with growing k until no random projection tells the data from the model.

    A new component starts at one of the points of least likelihood, or at a
    random point; the likeliest refit stays.
    """
    if not 0 < significance < 1:
        raise ValueError("a significance is between 0 and 1")
    n, mean, _ = scatter(points)
    d, rng = len(mean), np.random.default_rng(seed)
    projections = projections or int(-2.6198 * math.log(significance)) + 1
    samples = samples or int(3 / significance) + 1
    if samples < n:
        significance *= math.sqrt(samples / n)
    samples = min(samples, n)
    model, rounds = mixture(points, k, repeats=3, seed=seed), 0
    while True:
        rounds += 1
        rejected = False
        for _ in range(projections):
            axis = rng.normal(0, 1 / math.sqrt(d), d)
            axis /= max(np.linalg.norm(axis), 1e-300)
            drawn = model.projected(axis).sample(samples, rng)[:, 0]
            values = turned(points, axis[:, None]).select(F.col("features")[0].alias("x"))
            if ks_p_value(*ks_statistic(values, drawn), samples) < significance:
                rejected = True
                break
        if not rejected or model.k >= n or (max_k is not None and model.k >= max_k):
            return PgModel(model, rounds)
        at_random = int(round(new_centres * random_share))
        worst = model.scored(points).orderBy("log_likelihood", "id").limit(new_centres - at_random).select("features").collect()
        some = points.orderBy(F.xxhash64("id", F.lit(seed + rounds)), "id").limit(at_random).select("features").collect()
        starts = [np.array(r["features"]) for r in [*worst, *some]]
        model = max((fit_mixture(points, np.concatenate([model.means, c[None]])) for c in starts), key=lambda m: m.score)

