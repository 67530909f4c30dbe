"""Leading eigenvectors of sparse symmetric matrices given as edge tables.

Block Lanczos with full re-orthogonalisation.  A basis is a table of one row a
node, (id, q) with the node's entry in every basis vector.  A product with the
matrix is a join of edges with the newest block and a sum by row; inner products
are small matrices added up over tasks.  The driver holds matrices as wide as
the basis, never a vector of nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.lineage import cut

#: Directions shorter than this, relative to the longest of their block, count as zero.
TINY = 1e-14


def gram(rows: DataFrame, column: str = "q") -> np.ndarray:
    """Inner products of all columns of an array column, added up over tasks."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(total)), pa.int32()), "x": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select(F.col(column).alias("q")).mapInArrow(add, "row int, x array<double>").select("row", F.posexplode("x").alias("col", "x"))
    cells = parts.groupBy("row", "col").agg(F.sum("x").alias("x")).collect()  # as wide as the basis
    width = max((r["col"] for r in cells), default=-1) + 1
    out = np.zeros((width, width))
    for r in cells:
        out[r["row"], r["col"]] = r["x"]
    return out


def times(rows: DataFrame, matrix: np.ndarray, column: str = "q", keep: int | None = None) -> DataFrame:
    """(id, q): rows of an array column times a small matrix, behind the first ``keep`` of their own entries."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = x @ matrix if keep is None else np.concatenate([x[:, :keep], x @ matrix], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "q"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col(column).alias("q")).mapInArrow(run, f"id {kind}, q array<double>")


def product(edges: DataFrame, rows: DataFrame, first: int, width: int) -> DataFrame:
    """(id, q): each row's entries, and behind them those of the matrix times entries first .. first + width."""
    block = rows.select(F.col("id").alias("j"), F.slice("q", first + 1, width).alias("v"))
    sums = edges.join(block, "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col("v")[k]).alias(f"y{k}") for k in range(width)])
    zero = [F.coalesce(f"y{k}", F.lit(0.0)) for k in range(width)]
    return rows.join(sums.withColumnRenamed("i", "id"), "id", "left").select("id", F.concat("q", F.array(*zero)).alias("q"))


def _directions(g: np.ndarray, scale: float) -> np.ndarray:
    """Combinations of columns with inner products g that are orthonormal; those of no length are left out."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    held = values > max(TINY * max(scale, 1e-300), 0.0)
    return vectors[:, held] / np.sqrt(values[held])


def _random_block(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """Behind each row's entries ``width`` numbers from hashes of its id, so that a task run again draws the same."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 52)) / float(1 << 51) - 1.0
    return rows.select("id", F.concat("q", F.array(*[unit(k) for k in range(width)])).alias("q"))


def _orthonormal(rows: DataFrame, held: int, g: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """Rows whose entries from ``held`` on became orthonormal, to each other and to those before; how many are left.

    The part along the basis is taken off again where little was left of some
    direction, since a difference of near-equal vectors is mostly rounding.
    ``g``: inner products, where known.
    """
    while True:
        g = gram(rows) if g is None else g
        scale = float(np.trace(g[held:, held:]))
        along = g[:held, held:]
        rest = g[held:, held:] - along.T @ along
        turn = _directions(rest, scale)
        mix = np.concatenate([-along @ turn, turn])
        rows = cut(times(rows, mix, keep=held))
        if not mix.shape[1] or np.abs(turn).max() ** 2 * scale < 1e6:
            return rows, mix.shape[1]
        g = None


def leading(edges: DataFrame, k: int, ids: DataFrame | None = None, block: int = 16, most: int | None = None, tolerance: float = 1e-6, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The k eigenvalues of largest absolute value, and (id, q) with each node's entries in their vectors.

    ``edges``: (i, j, w), both directions of each pair, at most one row each;
    ``ids``: (id) of all nodes, where some have no edge.  A step adds a block to
    the basis; after ``most`` vectors (4 k + 4 blocks, if not given) the best 2 k Ritz vectors
    start a new basis.  Ends when all k residuals are under ``tolerance`` times
    the largest absolute value (below 1e-7 they are rounding).  A matrix without entries has eigenvalues 0.
    """
    edges = cut(edges.select("i", "j", F.col("w").cast("double").alias("w")).where("w <> 0").repartition("j"))
    nodes = (edges.select(F.col("i").alias("id")) if ids is None else ids.select("id")).distinct()
    nodes = cut(nodes.select("id", F.array().cast("array<double>").alias("q")))
    n = nodes.count()
    k, block = min(k, n), min(block, n)
    most = min(n, most or 4 * k + 4 * block)
    rows, width = _orthonormal(cut(_random_block(nodes, block, seed)), 0)
    basis, done, draw = width, 0, seed
    t = np.zeros((0, 0))  # the matrix in the basis
    for _ in range(rounds):
        wide = cut(product(edges, rows, done, basis - done))
        g = gram(wide)
        inner = g[:basis, basis:]  # basis times matrix times newest block
        t = np.block([[t, inner[:done]], [inner[:done].T, (inner[done:] + inner[done:].T) / 2]]) if done else (inner + inner.T) / 2
        values, vectors = np.linalg.eigh(t)
        order = np.argsort(-np.abs(values), kind="stable")
        values, vectors = values[order], vectors[:, order]
        # what the product of the newest block has outside the basis is all that Ritz vectors miss
        outside = g[basis:, basis:] - inner.T @ inner
        misses = np.sqrt(np.maximum(np.einsum("ak,ab,bk->k", vectors[done:, :k], outside, vectors[done:, :k]), 0)) if len(values) >= k else np.full(k, np.inf)
        limit = tolerance * max(abs(values[0]), 1e-300)
        if basis >= n or (len(values) >= k and misses.max() <= limit):
            return values[:k], cut(times(rows, vectors[:, :k]))
        rows, width = _orthonormal(wide, basis, g)
        if basis + width > most and basis > 2 * k:
            # thick restart: the best Ritz vectors, and what their products have outside the old basis
            kept = min(2 * k, basis - 1)
            mix = np.zeros((basis + width, kept + width))
            mix[:basis, :kept], mix[basis:, kept:] = vectors[:, :kept], np.eye(width)
            rows = cut(times(rows, mix))
            t, basis = np.diag(values[:kept]), kept
        if not width:  # the basis holds an invariant space; go on in another
            draw += 1
            rows, width = _orthonormal(cut(_random_block(rows, min(block, n - basis), draw)), basis)
        done, basis = basis, basis + width
    raise RuntimeError("no convergence; raise rounds or most")
