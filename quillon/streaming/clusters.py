"""Streams of points: labels by a fitted model, contingency by window, and k-means that follows a stream."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.partition import Model, _moments


def windowed_contingency(stream: DataFrame, time: str, true: str, pred: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, true, pred, n) of each window of event time; rows later than ``late`` are left out, as the watermark has it."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "true", "pred", "n")


class OnlineKMeans:
    """Centres as running means of the points that each had; a batch counts once, even if it is sent again.

    The state, k centres with their weights and the number of the last batch, is
    written to a folder all machines share after each batch, under a name of its
    own, so that a restarted query goes on from there.
    """

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray | None = None, decay: float = 1.0):
        """``decay``: what a weight is multiplied with before each batch; 1 never forgets."""
        self.spark, self.path, self.decay = spark, path, decay
        self.batch, self.centres, self.weights = -1, centres, None
        if not self._restore() and centres is None:
            raise ValueError("first centres are needed")
        if self.weights is None:
            self.centres = np.asarray(self.centres, float)
            self.weights = np.zeros(len(self.centres))

    def _restore(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return False
        rows = self.spark.read.schema("batch long, state string").parquet(f"{self.path}/batch-*").orderBy(F.desc("batch")).limit(1).collect()
        if not rows:
            return False
        state = json.loads(rows[0]["state"])
        self.batch, self.centres, self.weights = rows[0]["batch"], np.array(state["centres"]), np.array(state["weights"])
        return True

    def update(self, points: DataFrame, batch: int) -> None:
        """Take in one batch: for ``foreachBatch``."""
        if batch <= self.batch:
            return
        n, residuals, _ = (m[:, 0] for m in _moments(points, self.centres))
        self.weights = self.weights * self.decay + n
        self.centres = self.centres + residuals / np.maximum(self.weights, 1e-300)[:, None]
        state = json.dumps({"centres": self.centres.tolist(), "weights": self.weights.tolist()})
        self.spark.createDataFrame([(batch, state)], "batch long, state string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        self.batch = batch

    @property
    def model(self) -> Model:
        return Model(self.centres, float("nan"))

    def follow(self, stream: DataFrame, checkpoint: str):
        """Start a query that takes in all that is there and then ends."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
