"""Sparse features as rows (id, feature, value): selected by sum or variance before anything is made dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statistics(cells: DataFrame, rows: int) -> DataFrame:
    """(feature, total, variance) over ``rows`` rows, those without the feature as zeros; summed in tasks before the shuffle."""
    v = F.col("value")
    sums = cells.groupBy("feature").agg(F.sum(v).alias("total"), F.sum(v * v).alias("square"))
    return sums.select("feature", "total", (F.col("square") / rows - (F.col("total") / rows) ** 2).alias("variance"))


def select_features(cells: DataFrame, n: int, rows: int, by: str = "total", least: float | None = None) -> DataFrame:
    """(feature, at, total, variance) of the n features of the largest ``by`` (ties: the first), numbered in their own order.

    ``least``: features whose variance is not above it are left out.  Cells with
    a null feature or value count as absent; several cells of one row and feature
    are not added up here.
    """
    if by not in ("total", "variance"):
        raise ValueError("features are selected by total or variance")
    found = statistics(cells.where("feature is not null and value is not null"), rows)
    if least is not None:
        found = found.where(F.col("variance") > least)
    kept = found.orderBy(F.desc(by), "feature").limit(n)
    # n rows in one task
    return kept.withColumn("at", F.row_number().over(Window.orderBy("feature")) - 1).select("feature", "at", "total", "variance")


def restrict(cells: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, at, value): the cells of selected features, still sparse; equal cells of a row are added up."""
    kept = cells.where("value is not null").join(F.broadcast(selected.select("feature", "at")), "feature")
    return kept.groupBy("id", "at").agg(F.sum("value").alias("value"))


def dense(ids: DataFrame, cells: DataFrame, selected: DataFrame, size: int) -> DataFrame:
    """The rows of ``ids`` (a column id beside any others) with an array of ``size`` features; rows without any are zeros.

    A row holds ``size`` numbers; cells travel as they are, and never n x d
    zeros.  Repeated ids keep their rows.
    """
    own = restrict(cells, selected).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("value").cast("double")))).alias("cells"))  # size entries at most
    value = lambda k: F.coalesce(F.col("cells")[k], F.lit(0.0))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value) if size else F.expr("cast(array() as array<double>)")
    zeros = F.array_repeat(F.lit(0.0), size)
    return ids.join(own, "id", "left").withColumn("features", F.when(F.col("cells").isNull(), zeros).otherwise(filled)).drop("cells")
