"""Comparing sets of labelings (several label columns each)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.contingency import best_assignment

AGGREGATIONS = ("max", "min", "permut-max", "permut-min", "mean", "mean_wo_diag")


def cluster_counts(df: DataFrame, columns: list[str]) -> list[int]:
    """How many clusters, outliers (negative) not counted, each labeling has: one pass over the points."""
    row = df.agg(*[F.count_distinct(F.when(F.col(c) >= 0, F.col(c))).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [row[k] for k in range(len(columns))]


def without_noise_spaces(df: DataFrame, columns: list[str]) -> list[str]:
    """The labelings that have not just one cluster."""
    return [c for c, n in zip(columns, cluster_counts(df, columns)) if n != 1]


def n_clusters_correct(df: DataFrame, true: list[str], pred: list[str], check_subset: bool = True, remove_noise_spaces: bool = True) -> bool:
    """Whether the true labelings' numbers of clusters are among (or are) those of the predicted ones.

    Noise spaces are removed from the truth only.
    """
    if remove_noise_spaces:
        true = without_noise_spaces(df, true)
    a, b = sorted(cluster_counts(df, true)) if true else [], sorted(cluster_counts(df, pred))
    if not check_subset:
        return a == b
    return all(a.count(x) <= b.count(x) for x in set(a))


def labelings_matrix(df: DataFrame, true: list[str], pred: list[str]) -> DataFrame:
    """(true, pred, nmi) for each pair of labelings, from one aggregation over the stacked label columns."""
    stack = lambda names: F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("label")) for n in names])
    pairs = df.select(F.explode(stack(true)).alias("t"), stack(pred).alias("ps")).select("t", F.explode("ps").alias("p"))
    cells = pairs.groupBy(F.col("t.name").alias("true"), F.col("p.name").alias("pred"), F.col("t.label").alias("a"), F.col("p.label").alias("b")).agg(F.count("*").alias("n"))
    key = ["true", "pred"]
    entropy = lambda by, name: cells.groupBy(*key, *by).agg(F.sum("n").alias("n")).groupBy(*key).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s")).select(*key, (F.log("m") - F.col("s") / F.col("m")).alias(name))
    h = entropy(["a", "b"], "hab").join(entropy(["a"], "ha"), key).join(entropy(["b"], "hb"), key)
    mi = F.col("ha") + F.col("hb") - F.col("hab")
    nmi = F.when(F.col("ha") + F.col("hb") < 1e-12, 1.0).otherwise(2 * mi / (F.col("ha") + F.col("hb")))
    return h.select(*key, (F.round(nmi, 6) + 0.0).alias("nmi"))


def aggregate_matrix(matrix: np.ndarray, how: str) -> float:
    """One score of a labelings matrix (rows: true)."""
    how, m = how.lower(), np.asarray(matrix, float)
    if how not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {how!r}; one of {', '.join(AGGREGATIONS)}")
    if how == "mean":
        return float(m.mean())
    if how == "mean_wo_diag":
        if m.shape[0] != m.shape[1]:
            raise ValueError("the matrix must be square")
        return float((m.sum() - m.trace()) / (m.shape[0] * (m.shape[0] - 1)))
    if how in ("max", "min"):
        return float(getattr(m, how)(axis=1).sum() / m.shape[0])
    side = max(m.shape)
    padded = np.zeros((side, side))
    padded[: m.shape[0], : m.shape[1]] = m
    columns = best_assignment(padded if how == "permut-max" else padded.max() - padded)
    return float(padded[np.arange(side), columns].sum() / m.shape[0])
