"""Checks of points and labels before they are used; each is one pass with map-side sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_points(points: DataFrame, id_col: str = "id", features: str = "features", least: int = 1, numbers: bool = True) -> tuple[int, int]:
    """(points, dimensions) of a valid table, else ValueError.

    Features must be arrays of one length, without nulls and, if ``numbers``,
    without NaN or infinite values; ids must not be null or repeated.
    """
    for c in (id_col, features):
        if c not in points.columns:
            raise ValueError(f"column {c} is missing")
    f = F.col(features)
    bad = F.exists(f, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) if numbers else F.exists(f, lambda x: x.isNull())
    row = points.agg(
        F.count("*").alias("n"),
        F.min(F.size(f)).alias("low"),
        F.max(F.size(f)).alias("high"),
        F.count(F.when(f.isNull() | bad, 1)).alias("bad"),
        F.count(F.when(F.col(id_col).isNull(), 1)).alias("unnamed"),
    ).first()
    if row["n"] < least:
        raise ValueError(f"{row['n']} points, at least {least} are needed")
    if row["bad"]:
        raise ValueError(f"{row['bad']} points have features that are null, NaN or infinite")
    if row["n"] and (row["low"] != row["high"] or row["low"] < 1):
        raise ValueError("features must be arrays of one length, of one number at least")
    if row["unnamed"] or points.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("ids must be present and unique")
    return row["n"], row["high"] or 0


def check_labels(df: DataFrame, columns: list[str]) -> int:
    """Number of rows; ValueError if a labeling is missing, not of integers, or has nulls."""
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"column {c} is missing")
        if df.schema[c].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"labels of {c} are not integers")
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    if any(row[k + 1] != row["n"] for k in range(len(columns))):
        raise ValueError("labels must not be null")
    return row["n"]


def check_same_points(points: DataFrame, labels: DataFrame, id_col: str = "id") -> int:
    """Number of points; ValueError unless both tables have the same ids, once each."""
    counts = points.select(id_col, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(labels.select(id_col, F.lit(0), F.lit(1))).groupBy(id_col).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = counts.agg(F.count("*").alias("n"), F.count(F.when((F.col("a") != 1) | (F.col("b") != 1), 1)).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} ids are not in both tables once")
    return row["n"]


def check_estimator(fit, points: DataFrame, id_col: str = "id") -> None:
    """Contract of an estimator ``fit(points) -> (id, cluster)``: a label a point, the same again, and refusals of bad tables."""
    first, second = (fit(points).select(id_col, "cluster") for _ in range(2))
    n = check_same_points(points, first, id_col)
    if first.join(second.withColumnRenamed("cluster", "again"), id_col).where("cluster = again").count() != n:
        raise ValueError("two fits with one seed differ")
    if first.where("cluster < -1").limit(1).count():
        raise ValueError("labels are -1 for noise and from 0 on for clusters")
