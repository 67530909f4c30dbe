"""Scaling, images and texts as matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ZNormalizer:
    """Means and deviations, one of all values or one a feature; a deviation of 0 counts as 1."""

    mean: np.ndarray
    deviation: np.ndarray

    @staticmethod
    def fit(points: DataFrame, by_feature: bool = False, features: str = "features") -> ZNormalizer:
        """Moments are summed in tasks around the first point of each; no feature is exploded."""

        def add(frames):
            n, mean, square = 0, None, None
            for frame in frames:
                if not len(frame):
                    continue
                x = np.stack(frame[features]).astype(float)
                m, own = len(x), x.mean(0)
                spread = ((x - own) ** 2).sum(0)
                if mean is None:
                    n, mean, square = m, own, spread
                else:  # Chan et al.: moments of a union
                    d = own - mean
                    square = square + spread + d * d * n * m / (n + m)
                    mean, n = mean + d * m / (n + m), n + m
            if n:
                yield pd.DataFrame({"n": [n], "mean": [mean], "square": [square]})

        parts = points.select(features).mapInPandas(add, "n long, mean array<double>, square array<double>").collect()  # a row a task
        if not parts:
            raise ValueError("no points")
        n = np.array([p["n"] for p in parts], float)
        means, squares = np.array([p["mean"] for p in parts]), np.array([p["square"] for p in parts])
        mean = (n[:, None] * means).sum(0) / n.sum()
        square = squares.sum(0) + (n[:, None] * (means - mean) ** 2).sum(0)
        if not by_feature:
            whole = mean.mean()
            square = np.full(len(mean), (square.sum() + n.sum() * ((mean - whole) ** 2).sum()) / len(mean))
            mean = np.full(len(mean), whole)
        deviation = np.sqrt(square / n.sum())
        return ZNormalizer(mean, np.where(deviation > 0, deviation, 1.0))

    def _scaled(self, features: Column, back: bool) -> Column:
        mean, deviation = (F.array(*[F.lit(float(x)) for x in v]) for v in (self.mean, self.deviation))
        parts = F.arrays_zip(features.cast("array<double>").alias("x"), mean.alias("m"), deviation.alias("s"))
        return F.transform(parts, (lambda e: e["x"] * e["s"] + e["m"]) if back else (lambda e: (e["x"] - e["m"]) / e["s"]))

    def transform(self, points: DataFrame, features: str = "features") -> DataFrame:
        return points.withColumn(features, self._scaled(F.col(features), False))

    def inverse_transform(self, points: DataFrame, features: str = "features") -> DataFrame:
        return points.withColumn(features, self._scaled(F.col(features), True))


def flatten_images(images: DataFrame, order: str = "HWC", image: str = "image", features: str = "features") -> DataFrame:
    """Nested image arrays as flat features, channels first; ``order`` of the dimensions is HW, HWC, CHW, HWD or HWDC."""
    if order not in ("HW", "HWC", "CHW", "HWD", "HWDC"):
        raise ValueError("unknown order of dimensions")
    x = F.col(image)
    if order.endswith("C") or order == "HWDC":
        depth = len(order) - 1
        channels = x
        for _ in range(depth):
            channels = channels[0]
        inner = lambda v, c, k: F.transform(v, (lambda e: inner(e, c, k - 1)) if k > 1 else (lambda e: e[c]))
        x = F.transform(F.sequence(F.lit(0), F.size(channels) - 1), lambda c: inner(F.col(image), c, depth))
    for _ in range(len(order) - 1):
        x = F.flatten(x)
    return images.withColumn(features, F.transform(x, lambda e: e.cast("double")))


def unflatten_images(points: DataFrame, shape: tuple[int, ...], image: str = "image", features: str = "features") -> DataFrame:
    """Flat features as nested arrays of a shape with channels first (C, H, W or H, W); with three dimensions channels go last."""

    def cut(x: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1), lambda k: F.slice(x, k * size + 1, F.lit(size)))

    x = F.col(features)
    for size in reversed(shape[1:]):
        x = cut(x, size)
    if len(shape) == 3:
        c, h, w = shape
        planes = x
        x = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda j: F.transform(planes, lambda p: p[i][j])))
    return points.withColumn(image, x)


#: English words without content.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its no not of on or our she so that the their them then there these they this to was we were what when which who will with would you your"
).split()


def stem(word: Column) -> Column:
    """A word without common English endings: plurals, -ing, -ed, -ly, -ness."""
    out = F.regexp_replace(word, "(ss|us|is)$", "$1_")
    out = F.regexp_replace(out, "ies$", "y")
    out = F.regexp_replace(out, "([^s_])s$", "$1")
    out = F.regexp_replace(out, "_$", "")
    for ending in ("ing", "edly", "ed", "ly", "ness"):
        out = F.when(F.length(out) > len(ending) + 2, F.regexp_replace(out, f"{ending}$", "")).otherwise(out)
    return out


def terms_of(docs: DataFrame, id_col: str = "id", text_col: str = "text", stemming: bool = True, stop_words: bool = True) -> DataFrame:
    """(id, term) of each word of two letters or digits and more, in any script."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    if stemming:
        words = F.transform(words, stem)
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term"))


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text", stemming: bool = True, stop_words: bool = True) -> DataFrame:
    """(id, term, tf) of words of two letters or digits and more, in any script; counted within each text before any shuffle."""
    rows = terms_of(docs, id_col, text_col, stemming, stop_words)
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf")).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class TextMatrix:
    """Terms of a vocabulary, ordered, with their inverse document frequencies."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    tfidf: bool
    sublinear: bool
    stemming: bool
    stop_words: bool

    @staticmethod
    def fit(docs: DataFrame, id_col: str = "id", text_col: str = "text", tfidf: bool = True, stemming: bool = True, stop_words: bool = True, max_df: float = 1.0, min_df: float = 1, max_features: int = 2000, min_variance: float = 0.0, sublinear: bool = False) -> TextMatrix:
        """Vocabulary of the most frequent terms within the bounds of document frequency (shares if below or at 1.0 as floats), whose counts vary more than ``min_variance``."""
        n = docs.count()
        counts = term_counts(docs, id_col, text_col, stemming, stop_words)
        stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.sum(F.col("tf") * F.col("tf")).alias("square"))
        most = max_df * n if isinstance(max_df, float) else max_df
        least = min_df * n if isinstance(min_df, float) else min_df
        kept = stats.where((F.col("df") <= most) & (F.col("df") >= least)).orderBy(F.desc("total"), "term").limit(max_features)
        variance = F.col("square") / n - (F.col("total") / n) ** 2
        rows = kept.where(variance > min_variance).orderBy("term").collect()  # max_features at most
        return TextMatrix(tuple(r["term"] for r in rows), tuple(float(np.log((1 + n) / (1 + r["df"])) + 1) for r in rows), tfidf, sublinear, stemming, stop_words)

    def transform(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """(id, features): counts, or weights of length 1, of the vocabulary; documents without any of it are zeros."""
        known = docs.sparkSession.createDataFrame([(t, k, i) for k, (t, i) in enumerate(zip(self.terms, self.idf))], "term string, at int, idf double")
        counts = term_counts(docs, id_col, text_col, self.stemming, self.stop_words).join(F.broadcast(known), "term")
        tf = (1 + F.log("tf")) if self.sublinear else F.col("tf").cast("double")
        weighted = counts.withColumn("w", tf * F.col("idf") if self.tfidf else tf)
        cells = weighted.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        value = lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))
        dense = F.transform(F.sequence(F.lit(0), F.lit(len(self.terms) - 1)), lambda k: value(k) / F.col("size") if self.tfidf else value(k))
        zeros = F.array_repeat(F.lit(0.0), len(self.terms))
        return docs.select(id_col).join(cells, id_col, "left").select(id_col, F.when(F.col("m").isNull(), zeros).otherwise(dense).alias("features"))
