import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.functions import costs, dip
from quillon.operators import contingency as ct
from quillon.operators import geometry as geo
from quillon.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, oracle, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), oracle.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    for a, b in zip(rows(got), rows(want)):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(v, (int, float, np.number)) for v in a) else a == b


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def cells(spark, true, pred):
    return ct.contingency(spark.createDataFrame(list(zip(true, pred)), "t int, p int"), "t", "p")


def test_pair_counts_golden(spark):
    c = cells(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 0, 0, 0, 0, 1, 1, 1, 1])
    assert tuple(ct.pair_counts(c).first()) == (7, 9, 2, 18)
    assert tuple(ct.pair_scores(ct.pair_counts(c)).first()) == pytest.approx((7 / 18, 25 / 36, 7 / 16, 7 / 9, 14 / 25), abs=1e-6)


@pytest.mark.parametrize(("pred", "acc"), [([1, 1, 2, 2, 3, 3, 4, 4, 0, 0], 1.0), ([-1, -1, 1, 1, 1, 2, 3, 3, 4, 4], 0.9), (list(range(10)), 0.5), ([0] * 10, 0.2), ([0, 0, 0, 0, 2, 2, 3, 3, 4, -1], 0.7), ([4, 4, 4, 1, 2, 2, 3, 3, 0, -1], 0.8)])
def test_accuracy_golden(spark, pred, acc):
    assert ct.clustering_accuracy(cells(spark, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4], pred)) == pytest.approx(acc)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(30):
        g = rng.integers(0, 20, (5, 5))
        found = ct.best_assignment(g)
        assert sum(g[i, found[i]] for i in range(5)) == max(sum(g[i, p[i]] for i in range(5)) for p in permutations(range(5)))


def test_variation_of_information_golden(spark):
    c = cells(spark, [1, 1, 1, 1, 0, 0, 0, 0], [0, 0, 1, 1, 1, 1, 1, 1])
    assert ct.variation_of_information(c).first()[0] == pytest.approx(0.823959, abs=1e-6)


def test_costs_golden(spark):
    n = F.col("id") * 0 + 77
    got = spark.range(1).select(costs.integer(n, True), costs.integer(n))
    assert tuple(got.first()) == pytest.approx((12.328150766, 7.24955913584))


@pytest.mark.parametrize(
    ("sample", "want"),
    [([1] * 10 + [2] * 10, 0.25), ([1] * 20, 0.0), ([1, 1, 1, 2, 2, 2, 2, 2, 2.5, 2.5, 2.5], 0.1363636), ([-2, 0, 0.25, 0.5, 1, 1.1, 1.2, 1.3, 1.4, 1.5, 2, 3, 4, 4.5], 0.0535714), ([1, 2], 0.0), ([], 0.0)],
)
def test_dip_golden(sample, want):
    assert dip.dip(sample)[0] == pytest.approx(want, abs=1e-6)


def test_dip_invariants():
    rng = np.random.default_rng(0)
    for n in (5, 20, 200):
        x = rng.normal(size=n)
        d = dip.dip(x)[0]
        assert 0 <= d <= 0.25
        assert dip.dip(-x)[0] == pytest.approx(d) and dip.dip(3 * x + 7)[0] == pytest.approx(d)


def test_cvnn_golden(spark):
    x = [[0, 0], [0, 1], [1, 0], [1, 1], [5, 5], [4, 5], [5, 4], [4, 4]]
    points = spark.createDataFrame([(k, [float(v) for v in p], k // 4) for k, p in enumerate(x)], "id long, features array<double>, label int")
    assert tuple(geo.cvnn(points, 4).first()) == pytest.approx((0.25, (4 + 2 * 2**0.5) / 6 * 2), abs=1e-6)
