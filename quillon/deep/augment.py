"""Augmented rows beside their originals, for training that does not depend on the augmentation.

What is drawn for a row depends on the row and the seed only, so a task that
runs again draws the same, and each epoch, with a seed of its own, draws anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column of the augmented features.
OTHER = "augmented"


def draws(key: Column, seed: int, n: int) -> Column:
    """n numbers in [0, 1) of a row: 32 bits each of the MD5 of ``key:seed:block``, four a block."""
    block = lambda b: F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), b.cast("string")))
    number = lambda text, k: F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("double") / float(1 << 32)
    texts = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 4)), block)
    return F.slice(F.flatten(F.transform(texts, lambda t: F.array(*[number(t, k) for k in range(4)]))), 1, n)


def row_key(features: str = "features") -> Column:
    """A key of the features themselves: equal rows draw the same, whatever their order."""
    return F.xxhash64(F.col(features))


@dataclass(frozen=True)
class Affine:
    """Random rotation, shift and shear of images, flat with channels first; what comes from outside is ``fill``.

    ``degrees`` and ``shear``: bounds in degrees to both sides; ``shift``: share of
    height and width.
    """

    shape: tuple[int, int, int]
    degrees: float = 16.0
    shift: float = 0.1
    shear: float = 8.0
    fill: float = 0.0
    #: Numbers drawn for a row: angle, two shifts, shear.
    numbers: int = 4

    def __call__(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Rows under the transformations that their draws (rows, numbers) give; bilinear."""
        c, h, w = self.shape
        signed = 2 * u - 1
        angle, slant = np.radians(signed[:, 0] * self.degrees), np.radians(signed[:, 3] * self.shear)
        down, right = signed[:, 1] * self.shift * h, signed[:, 2] * self.shift * w
        # each target pixel's place in the source: shift and rotation undone, then the shear along rows
        rows, cols = np.mgrid[:h, :w].reshape(2, -1).astype(float)
        a = rows[None] - (h - 1) / 2 - down[:, None]
        b = cols[None] - (w - 1) / 2 - right[:, None]
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        y, z = cos * a - sin * b, sin * a + cos * b
        z = z - np.tan(slant)[:, None] * y
        y, z = y + (h - 1) / 2, z + (w - 1) / 2
        top, left = np.floor(y).astype(int), np.floor(z).astype(int)
        fy, fz = y - top, z - left
        planes, out = x.reshape(len(x), c, h * w) - self.fill, np.zeros((len(x), c, h * w))
        for dy, dz, share in ((0, 0, (1 - fy) * (1 - fz)), (0, 1, (1 - fy) * fz), (1, 0, fy * (1 - fz)), (1, 1, fy * fz)):
            i, j = top + dy, left + dz
            inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
            at = np.where(inside, i * w + j, 0)
            out += np.take_along_axis(planes, at[:, None, :], 2) * np.where(inside, share, 0.0)[:, None, :]
        return (out + self.fill).reshape(len(x), -1)


@dataclass(frozen=True)
class Noise:
    """Normal noise of a deviation on every feature, then a share of the features set to 0."""

    features: int
    deviation: float = 0.1
    dropped: float = 0.0

    @property
    def numbers(self) -> int:
        return 3 * self.features

    def __call__(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        a, b, drop = np.split(u, 3, axis=1)
        normal = np.sqrt(-2 * np.log(1 - a)) * np.cos(2 * math.pi * b)
        return np.where(drop < self.dropped, 0.0, x + self.deviation * normal)


def with_augmented(points: DataFrame, augment: Callable, seed: int = 0, key: Column | None = None) -> DataFrame:
    """Points with their augmented features beside them in ``augmented``.

    ``augment``: takes rows and their draws, ``augment.numbers`` a row; returns as
    many rows of the same size.  Null features are not allowed; an empty table
    stays empty.
    """

    @F.pandas_udf("array<double>")
    def run(features: pd.Series, u: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x = np.stack(features).astype(float)
        out = augment(x, np.stack(u).astype(float))
        if out.shape != x.shape:
            raise ValueError("augmented rows are of another size")
        return pd.Series(list(out), dtype=object)

    return points.withColumn(OTHER, run("features", draws(row_key() if key is None else key, seed, augment.numbers)))


def changes(points: DataFrame, augment: Callable, seed: int = 0) -> bool:
    """Whether the augmentation changes any row; one that does not teaches nothing."""
    return bool(with_augmented(points, augment, seed).where(F.exists(F.arrays_zip(F.col("features").cast("array<double>").alias("a"), F.col(OTHER).alias("b")), lambda e: e["a"] != e["b"])).limit(1).count())
