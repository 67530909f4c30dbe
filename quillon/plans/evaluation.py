"""Repeated evaluation of estimators: results as a table (dataset, algorithm, metric, repetition, value)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "dataset string, algorithm string, metric string, repetition int, value double"


@dataclass(frozen=True)
class Dataset:
    """``load`` gives (id, features[, true]); ``preprocess`` are functions from table to table."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    preprocess: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    ignore_algorithms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Algorithm:
    """``fit(points, seed=, **params)`` gives the points with a column cluster."""

    name: str
    fit: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)
    deterministic: bool = False
    preprocess: tuple[Callable[[DataFrame], DataFrame], ...] = ()


@dataclass(frozen=True)
class Metric:
    """``score(labelled)`` gives a number; ``kind`` is external (needs true), internal or custom."""

    name: str
    score: Callable[[DataFrame], float]
    kind: str = "external"


def evaluate(spark: SparkSession, datasets: list[Dataset], algorithms: list[Algorithm], metrics: list[Metric], repetitions: int = 10, seeds: list[int] | None = None, add_runtime: bool = True, add_n_clusters: bool = False) -> DataFrame:
    """Run all; a failed repetition has null values, which means and deviations skip."""
    seeds = list(range(repetitions)) if seeds is None else seeds
    if len(seeds) != repetitions:
        raise ValueError("one seed is needed for each repetition")
    rows = []
    for dataset in datasets:
        points = dataset.load(spark)
        for step in dataset.preprocess:
            points = step(points)
        for algorithm in algorithms:
            if algorithm.name in dataset.ignore_algorithms:
                continue
            own = points
            for step in algorithm.preprocess:
                own = step(own)
            for k in range(1 if algorithm.deterministic else repetitions):
                began = time.time()
                values: dict[str, float | None] = {m.name: None for m in metrics}
                labelled = None
                try:
                    fitted = algorithm.fit(own, seed=seeds[k], **algorithm.params)
                    labelled = points.drop("cluster").join(fitted.select("id", "cluster"), "id").persist()
                    labelled.count()
                    took = time.time() - began
                    for m in metrics:
                        if m.kind != "external" or "true" in labelled.columns:
                            values[m.name] = float(m.score(labelled))
                    if add_n_clusters:
                        values["n_clusters"] = float(labelled.agg(F.count_distinct("cluster")).first()[0])
                    if add_runtime:
                        values["runtime"] = took
                except Exception as error:  # a failing estimator must not end the series
                    print(f"{dataset.name}, {algorithm.name}, repetition {k}: {error}")
                finally:
                    if labelled is not None:
                        labelled.unpersist()
                rows += [(dataset.name, algorithm.name, name, k, value) for name, value in values.items()]
    return spark.createDataFrame(rows, SCHEMA)


def summarise(results: DataFrame) -> DataFrame:
    """(dataset, algorithm, metric, mean, std)"""
    return results.groupBy("dataset", "algorithm", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def rank(summary: DataFrame, lower_is_better: tuple[str, ...] = ("runtime",)) -> DataFrame:
    """Add the place of each algorithm for a dataset and metric, ties sharing a place."""
    value = F.when(F.col("metric").isin(*lower_is_better), F.col("mean")).otherwise(-F.col("mean"))
    return summary.withColumn("place", F.dense_rank().over(Window.partitionBy("dataset", "metric").orderBy(value.asc_nulls_last())))


def latex_table(summary: DataFrame, multiplier: float = 100, decimals: int = 1, lower_is_better: tuple[str, ...] = ("runtime",)) -> str:
    """A table with the best in bold and the second underlined; rows (dataset, metric), columns algorithms."""
    rows = rank(summary, lower_is_better).orderBy("dataset", "metric", "algorithm").collect()  # a report
    names = sorted({r["algorithm"] for r in rows})
    cells = {(r["dataset"], r["metric"], r["algorithm"]): r for r in rows}

    def cell(r) -> str:
        if r is None or r["mean"] is None:
            return "-"
        by = 1 if r["metric"] in lower_is_better else multiplier
        text = rf"${r['mean'] * by:.{decimals}f} \pm {r['std'] * by:.{decimals}f}$"
        return rf"\textbf{{{text}}}" if r["place"] == 1 else rf"\underline{{{text}}}" if r["place"] == 2 else text

    lines = [rf"\begin{{tabular}}{{ll{'r' * len(names)}}}", " & ".join(["dataset", "metric", *names]) + r" \\ \hline"]
    for d, m in sorted({(r["dataset"], r["metric"]) for r in rows}):
        lines.append(" & ".join([d, m, *[cell(cells.get((d, m, a))) for a in names]]).replace("_", r"\_") + r" \\")
    return "\n".join([*lines, r"\end{tabular}"]) + "\n"
