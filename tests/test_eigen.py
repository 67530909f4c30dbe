"""Leading eigenvectors of edge tables against dense solutions, and SpecialK on them."""

import numpy as np
import pytest

from quillon.operators.eigen import leading


def graph(n, seed, dense=0.1):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < dense, 1) * rng.random((n, n))
    return a + a.T


def table(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, w double").repartition(3)


def check(spark, a, k, **options):
    ids = spark.range(len(a)).select("id")
    values, rows = leading(table(spark, a), k, ids, **options)
    want = np.linalg.eigvalsh(a)
    want = want[np.argsort(-np.abs(want), kind="stable")][:k]
    assert np.allclose(np.abs(values), np.abs(want), atol=1e-7 * max(1, abs(want[0])))
    v = np.array([r["q"] for r in rows.orderBy("id").collect()])
    assert v.shape == (len(a), k) and np.allclose(v.T @ v, np.eye(k), atol=1e-8)
    assert np.abs(a @ v - v * values).max() < 1e-5 * max(1, abs(want[0]))


@pytest.mark.parametrize("n, k, options", [(60, 4, {}), (60, 2, {"block": 4, "most": 20}), (6, 6, {})])
def test_random_graphs(spark, n, k, options):
    check(spark, graph(n, n + k, 0.1 if n > 10 else 0.8), k, **options)


def test_invariant_spaces(spark):
    """Three equal components: every leading value is threefold, and a small block finds no more than one space at once."""
    one = graph(12, 3, 0.4)
    a = np.kron(np.eye(3), one)
    check(spark, a, 6, block=4)


def test_no_edges(spark):
    none = spark.createDataFrame([], "i long, j long, w double")
    values, rows = leading(none, 2, spark.range(5))
    assert np.allclose(values, 0) and rows.count() == 5
