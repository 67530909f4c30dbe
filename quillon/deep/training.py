"""Longer training: validation by hash split, early stopping, saved state, layerwise pretraining."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.deep.autograd import Tensor
from quillon.deep.networks import Autoencoder, Parameters, epoch, reconstruction
from quillon.operators.lineage import cut


def hash_split(points: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Points without and with about a share of the ids, by a hash, so that the same ids are held out in every run."""
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return points.where(part >= share), points.where(part < share)


@dataclass
class EarlyStopping:
    """Whether the loss has not fallen by more than ``least`` for ``patience`` epochs."""

    patience: int = 10
    least: float = 1e-4
    best: float = math.inf
    waited: int = 0

    def better(self, loss: float) -> bool:
        """Note a loss; True if it is the best so far."""
        if loss < self.best - self.least:
            self.best, self.waited = loss, 0
            return True
        self.waited += 1
        return False

    @property
    def stop(self) -> bool:
        return self.waited >= self.patience


def mean_loss(points: DataFrame, p: Parameters, loss: Callable, seed: int = 0) -> float:
    """Mean of a loss over all points without training; batches are what Spark hands over."""

    def run(frames):
        for frame in frames:
            if len(frame):
                x = np.stack(frame["features"]).astype(float)
                value = loss(x, {k: Tensor(v) for k, v in p.items()}, np.random.default_rng(seed))
                yield pd.DataFrame({"total": [float(value.data) * len(x)], "n": [len(x)]})

    row = points.select("features").mapInPandas(run, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    if not row[1]:
        raise ValueError("no points")
    return row[0] / row[1]


def save(spark: SparkSession, p: Parameters, folder: str, state: dict[str, float]) -> None:
    """Parameters and a few numbers as a table in a shared folder, in one file that is there whole or not at all."""
    rows = [(k, list(v.shape), np.ascontiguousarray(v, float).tobytes()) for k, v in p.items()] + [(f"#{k}", [], np.array(float(v)).tobytes()) for k, v in state.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={int(state['epoch']):06d}")


def load(spark: SparkSession, folder: str) -> tuple[Parameters, dict[str, float]] | None:
    """What was saved last, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    # a folder without _SUCCESS was being written when its job was lost
    done = sorted(x.getPath().toString() for x in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
    if not done:
        return None
    rows = spark.read.parquet(done[-1]).collect()  # one set of parameters
    values = {r["name"]: np.frombuffer(bytes(r["data"])).reshape(r["shape"]).copy() for r in rows}
    return {k: v for k, v in values.items() if k[0] != "#"}, {k[1:]: float(v.reshape(())) for k, v in values.items() if k[0] == "#"}


@dataclass(frozen=True)
class Trained:
    net: Autoencoder
    losses: tuple[float, ...] = ()
    validation: tuple[float, ...] = ()
    #: Epoch, from 0, whose parameters are kept.
    best_epoch: int = -1
    resumed_at: int = field(default=0)


def train(points: DataFrame, net: Autoencoder, loss: Callable | None = None, epochs: int = 100, validation: float = 0.1, stopping: EarlyStopping | None = None, folder: str | None = None, batch: int = 256, rate: float = 1e-3, seed: int = 0) -> Trained:
    """Train on all but a held-out share until ``epochs`` are over or the held-out loss rests; the best parameters are kept.

    ``folder``: of a shared file system; the best parameters so far are saved
    there after each epoch that improves them, and a later call goes on from what
    it finds.
    """
    loss = loss or reconstruction(net)
    stopping = stopping or EarlyStopping()
    spark = points.sparkSession
    own, held = (cut(x) for x in hash_split(points, validation, seed))
    p, first, best_epoch = net.parameters, 0, -1
    if folder and (found := load(spark, folder)):
        p, state = found
        first, best_epoch, stopping.best = int(state["epoch"]) + 1, int(state["epoch"]), state["loss"]
    best, losses, checks = p, [], []
    for e in range(first, epochs):
        p, value = epoch(own, p, loss, batch, rate, seed + e)
        losses.append(value)
        checks.append(mean_loss(held, p, loss, seed))
        if stopping.better(checks[-1]):
            best, best_epoch = p, e
            if folder:
                save(spark, p, folder, {"epoch": e, "loss": checks[-1]})
        if stopping.stop:
            break
    return Trained(net.with_parameters(best), tuple(losses), tuple(checks), best_epoch, first)


def _layer_loss(last: bool, corrupt: float):
    """Reconstruction of a layer's input, some of it set to 0, through one layer; inner layers are leaky rectifiers."""

    def loss(x, p, rng):
        seen = x * (rng.random(x.shape) >= corrupt) if corrupt else x
        z = Tensor(seen) @ p["ew0"] + p["eb0"]
        z = z if last else z.leaky()
        diff = z @ p["dw0"] + p["db0"] - x
        return (diff * diff).sum(1).mean()

    return loss


def stacked(points: DataFrame, layers, layer_epochs: int = 50, epochs: int = 50, corrupt: float = 0.2, batch: int = 256, rate: float = 1e-3, seed: int = 0) -> tuple[Autoencoder, list[list[float]]]:
    """An autoencoder whose layers are trained one after the other on what the ones before give, then all together; the losses of each part."""
    layers = tuple(layers)
    net, depth, every = Autoencoder.create(layers, seed), len(layers) - 1, []
    p = dict(net.parameters)
    rows = points.select("id", F.col("features").cast("array<double>").alias("features"))
    for k in range(depth):
        own = {"ew0": p[f"ew{k}"], "eb0": p[f"eb{k}"], "dw0": p[f"dw{depth - 1 - k}"], "db0": p[f"db{depth - 1 - k}"]}
        last, losses = k == depth - 1, []
        for e in range(layer_epochs):
            own, value = epoch(rows, own, _layer_loss(last, corrupt), batch, rate, seed + e)
            losses.append(value)
        every.append(losses)
        p |= {f"ew{k}": own["ew0"], f"eb{k}": own["eb0"], f"dw{depth - 1 - k}": own["dw0"], f"db{depth - 1 - k}": own["db0"]}
        if not last:
            rows = cut(_through(rows, own))
    losses = []
    for e in range(epochs):
        p, value = epoch(points, p, reconstruction(net), batch, rate, seed + e)
        losses.append(value)
    return net.with_parameters(p), [*every, losses]


def _through(rows: DataFrame, own: Parameters) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        return pd.Series(list((Tensor(np.stack(features)) @ own["ew0"] + own["eb0"]).leaky().data), dtype=object)

    return rows.withColumn("features", run("features"))
