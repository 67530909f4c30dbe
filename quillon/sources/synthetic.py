"""Generated matrices with one labeling for each subspace.

Every number is drawn from a hash of (row, dimension, seed): partitions and
retried tasks give the same rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(key: Column, *salt: int) -> Column:
    """In (0, 1)."""
    return (F.pmod(F.xxhash64(key, *map(F.lit, salt)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def _normal(key: Column, *salt: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(key, *salt, 1))) * F.cos(2 * math.pi * _uniform(key, *salt, 2))


def rotation(d: int, rng: np.random.Generator) -> np.ndarray:
    """A random rotation: orthogonal, of determinant 1."""
    q, r = np.linalg.qr(rng.normal(size=(d, d)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q


def nr_data(spark: SparkSession, n: int = 1000, clusters=(3, 3, 1), dims=(2, 2, 2), outliers=(0, 0, 0), std: float = 1.0, box=(-10, 10), rotate: bool = True, seed: int = 0) -> DataFrame:
    """(id, features, labels): Gaussian clusters in each subspace, independent of those of the others.

    Outliers of a subspace (label -1) are uniform in the box widened by four
    deviations; their number is expected, not exact, and so are cluster sizes.
    """
    if not len(clusters) == len(dims) == len(outliers):
        raise ValueError("clusters, dims and outliers must be of one length")
    rng = np.random.default_rng(seed)
    rows, columns, labels = spark.range(n), [], []
    for s, (k, d, out) in enumerate(zip(clusters, dims, outliers)):
        centres = rng.uniform(box[0], box[1], (k, d))
        label = F.when(_uniform(F.col("id"), seed, s, 7) < out / max(n, 1), -1).otherwise(F.floor(_uniform(F.col("id"), seed, s, 8) * k)).cast("int")
        labels.append(label)
        lo, hi = box[0] - 4 * std, box[1] + 4 * std
        for j in range(d):
            centre = F.element_at(F.array(*[F.lit(float(c[j])) for c in centres]), F.greatest(label, F.lit(0)) + 1)
            columns.append(F.when(label < 0, lo + _uniform(F.col("id"), seed, s, j, 9) * (hi - lo)).otherwise(centre + std * _normal(F.col("id"), seed, s, j)))
    rows = rows.select("id", F.array(*columns).alias("features"), F.array(*labels).alias("labels"))
    if rotate:
        v = rotation(sum(dims), rng)
        turned = [F.aggregate(F.zip_with("features", F.array(*[F.lit(float(x)) for x in v[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) for j in range(v.shape[1])]
        rows = rows.select("id", F.array(*turned).alias("features"), "labels")
    return rows


def subspace_data(spark: SparkSession, n: int = 1000, clusters: int = 3, dims=(2, 2), outliers=(0, 0), std: float = 1.0, box=(-10, 10), rotate: bool = True, seed: int = 0) -> DataFrame:
    """(id, features, label): one subspace with clusters and one without."""
    found = nr_data(spark, n, (clusters, 1), dims, outliers, std, box, rotate, seed)
    return found.select("id", "features", F.col("labels")[0].alias("label"))
