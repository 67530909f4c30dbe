"""Trees, labelings, sources, generators, partitioning estimators and the evaluation harness."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import labelings, partition, trees
from quillon.plans import evaluation
from quillon.sources import files, synthetic

TRUE = [k for k in range(5) for _ in range(3)]


def _tree(spark):
    tree = trees.ClusterTree()
    for c in (0, 0, 0, 1, 1):
        tree.split(c)
    return tree


@pytest.mark.parametrize(
    "pred, dendrogram, leaf",
    [
        ([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 0, 0, 0], 1.0, 1.0),
        ([1, 2, 3] * 5, 0.2, 0.2),
        ([0, 0, 0, 1, 1, 1, 2, 2, 2, 0, 0, 0, 3, 3, 3], 0.8, 0.8),
    ],
)
def test_tree_purities(spark, pred, dendrogram, leaf):
    points = spark.createDataFrame(list(zip(TRUE, pred)), "true int, leaf int")
    assert trees.dendrogram_purity(points, _tree(spark).paths(spark)).first()[0] == pytest.approx(dendrogram, abs=1e-6)
    assert trees.leaf_purity(points).first()[0] == pytest.approx(leaf, abs=1e-6)


def test_dendrogram_purity_against_pairs(spark):
    rng = np.random.default_rng(1)
    merges = [(0, 1), (2, 3), (5, 6), (4, 7)]
    under = {k: {k} for k in range(5)}
    for k, (a, b) in enumerate(merges):
        under[5 + k] = under[a] | under[b]
    true, leaf = rng.integers(0, 3, 60), rng.integers(0, 5, 60)
    shares = []
    for i, j in itertools.combinations(range(60), 2):
        if true[i] == true[j]:
            node = min((s for s in under.values() if {leaf[i], leaf[j]} <= s), key=len)
            inside = [t for t, x in zip(true, leaf) if x in node]
            shares.append(inside.count(true[i]) / len(inside))
    points = spark.createDataFrame([(int(a), int(b)) for a, b in zip(true, leaf)], "true int, leaf int")
    assert trees.dendrogram_purity(points, trees.linkage_paths(spark, merges)).first()[0] == pytest.approx(np.mean(shares), abs=1e-6)


def test_labelings(spark):
    rows = [(k // 3, k % 3, 0, k % 2) for k in range(9)]
    df = spark.createDataFrame(rows, "a int, b int, z int, c int")
    assert labelings.without_noise_spaces(df, ["a", "b", "z"]) == ["a", "b"]
    assert labelings.n_clusters_correct(df, ["a", "z"], ["b", "c"])
    assert not labelings.n_clusters_correct(df, ["a"], ["b", "c"], check_subset=False)
    assert not labelings.n_clusters_correct(df, ["a", "b"], ["b", "c"])
    found = {(r["true"], r["pred"]): r["nmi"] for r in labelings.labelings_matrix(df, ["a", "b"], ["a", "b"]).collect()}
    assert found == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0}


@pytest.mark.parametrize("how, expected", [("max", 1.5 / 3), ("min", 0.8 / 3), ("permut-max", 1.4 / 3), ("permut-min", 0.9 / 3), ("mean", 3.5 / 9)])
def test_labelings_aggregate(how, expected):
    assert labelings.aggregate_matrix(np.array([[0.0, 0.1, 0.2], [1, 0.9, 0.8], [0, 0.2, 0.3]]), how) == pytest.approx(expected)


def _blobs(spark, k=4, n=400, d=2):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [20, 0], [0, 20], [20, 20]])[:k]
    rows = [(i, [float(x) for x in centres[i % k] + rng.normal(size=d)], i % k) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, true int")


def test_kmeans_recovers_blobs(spark):
    points = _blobs(spark)
    model = partition.kmeans(points, 4)
    labelled = model.predict(points).groupBy("true", "cluster").count().collect()
    assert len(labelled) == 4 and {r["count"] for r in labelled} == {100}
    x = np.array([r["features"] for r in points.select("features").collect()])
    brute = (((x[:, None] - model.centres) ** 2).sum(2)).min(1).sum()
    assert model.inertia == pytest.approx(brute, rel=1e-6)


def test_splitting_estimators_find_k(spark):
    points = _blobs(spark).persist()
    assert partition.xmeans(points, k=2, max_k=10).k == 4
    assert partition.gmeans(points, k=1, max_k=10).k == 4
    assert partition.xmeans(points, k=2, max_k=3).k == 3
    points.unpersist()


def test_gap_statistic(spark):
    points = _blobs(spark, k=2, n=120).coalesce(1).persist()
    assert partition.gap_statistic(points, max_k=4, n_refs=3)[0] == 2
    points.unpersist()


def test_anderson_darling_against_plain_formula(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.normal(size=200))
    z, n = (x - x.mean()) / x.std(ddof=1), len(x)
    import math

    cdf = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in z])
    i = np.arange(1, n + 1)
    a2 = -n - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))).sum() / n
    got = partition.anderson_darling(spark.createDataFrame([(0, float(v)) for v in x] + [(1, 3.0)], "group int, x double"))
    got = {r["group"]: r["a2"] for r in got.collect()}
    assert got[0] == pytest.approx(a2 * (1 + 0.75 / n + 2.25 / n**2), rel=1e-6) and got[1] is None


def test_anderson_p_value_falls():
    p = [partition.anderson_p_value(a) for a in (0.1, 0.3, 0.5, 0.7, 2, 50, 1e4)]
    assert p == sorted(p, reverse=True) and p[-1] == 0


def test_scatter(spark):
    points = _blobs(spark, n=50)
    n, mean, s = partition.scatter(points)
    x = np.array([r[0] for r in points.select("features").collect()])
    assert n == 50 and np.allclose(mean, x.mean(0)) and np.allclose(s, np.cov(x.T, ddof=0) * 50)


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2,a\n3,?,b\n\n5, 6 ,b\n")
    got = sorted((r["features"], r["labels"]) for r in files.read_delimited(spark, str(tmp_path / "t.csv")).collect())
    assert got == [([1.0, 2.0], ["a"]), ([5.0, 6.0], ["b"])]
    (tmp_path / "s.txt").write_text("# c\n1  0.5 0.25\n@x\n2  1e1 3\n")
    got = sorted((r["label"], r["features"]) for r in files.read_series(spark, str(tmp_path / "s.txt")).collect())
    assert got == [(1, [0.5, 0.25]), (2, [10.0, 3.0])]
    np.savez(tmp_path / "m.npz", train_images=np.arange(8).reshape(2, 2, 2), train_labels=np.array([[1], [0]]))
    got = [(r["row"], r["features"], r["labels"]) for r in files.read_npz(spark, str(tmp_path / "m.npz")).orderBy("row").collect()]
    assert got == [(0, [0.0, 1, 2, 3], [1]), (1, [4.0, 5, 6, 7], [0])]


def test_keep_evenly(spark):
    frames = spark.createDataFrame([(v, k) for v in "ab" for k in range(10)], "v string, k int")
    got = files.keep_evenly(frames, 0.6, "v", "k").groupBy("v").count().collect()
    assert {r["count"] for r in got} == {6}
    assert files.keep_evenly(frames, 1.0, "v", "k").count() == 20


def test_generators(spark):
    df = synthetic.nr_data(spark, 300, outliers=(30, 0, 0), seed=2)
    rows = df.orderBy("id").collect()
    assert len(rows) == 300 and all(len(r["features"]) == 6 and len(r["labels"]) == 3 for r in rows)
    assert rows == df.repartition(5).orderBy("id").collect()
    assert {r["labels"][0] for r in rows} == {-1, 0, 1, 2} and {r["labels"][2] for r in rows} == {0}
    v = synthetic.rotation(4, np.random.default_rng(0))
    assert np.allclose(v @ v.T, np.eye(4)) and np.linalg.det(v) == pytest.approx(1)
    assert synthetic.subspace_data(spark, 10).columns == ["id", "features", "label"]


def test_evaluation(spark):
    def fit(points, seed, k):
        return partition.kmeans(points, k, seed).predict(points)

    def fail(points, seed):
        raise RuntimeError("no fit")

    share = evaluation.Metric("clusters", lambda df: df.agg(F.count_distinct("cluster")).first()[0], "custom")
    found = evaluation.evaluate(spark, [evaluation.Dataset("blobs", lambda s: _blobs(s, n=80))], [evaluation.Algorithm("km", fit, {"k": 4}, deterministic=True), evaluation.Algorithm("bad", fail)], [share], repetitions=2)
    summary = evaluation.summarise(found)
    got = {(r["algorithm"], r["metric"]): r["mean"] for r in summary.collect()}
    assert got["km", "clusters"] == 4 and got["bad", "clusters"] is None
    text = evaluation.latex_table(summary, multiplier=1)
    assert r"\textbf{$4.0 \pm 0.0$}" in text and " - " in text.replace("&", " ")


def test_partitions_without_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(20.0 * (k % 2), 1.0, 2)]) for k in range(10)]
    points = spark.createDataFrame(rows, "id long, features array<double>").repartition(16, "id")
    model = partition.kmeans(points, 2, seed=1)
    assert sorted(np.round(model.centres[:, 0] / 20).tolist()) == [0, 1]
    assert partition.gmeans(points, 1).k >= 1 and partition.xmeans(points, 1).k >= 1
    n, mean, _ = partition.scatter(points)
    assert n == 10 and np.allclose(mean, np.mean([r[1] for r in rows], 0))


def test_gmeans_counts_equal_points(spark):
    """Weighted distinct points give the statistic and sums of all points, and the rounds read no more rows than these."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=400) + rng.choice([0, 6], 400), 1)
    whole = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(x)], "group int, x double")
    weighted = whole.groupBy("group", "x").agg(F.count("*").alias("weight"))
    one, other = ({r["group"]: (r["n"], r["a2"]) for r in partition.anderson_darling(t).collect()} for t in (whole, weighted))
    assert one.keys() == other.keys() and all(one[g][0] == other[g][0] == 200 and abs(one[g][1] - other[g][1]) < 1e-8 for g in one)
    grid = spark.range(6000).select("id", F.array((F.col("id") % 4 * 10 + F.col("id") % 3).cast("double"), (F.col("id") % 5).cast("double")).alias("features"))
    with partition.counted(grid) as distinct:
        assert distinct.count() == 60
        for children in (None, np.array([[[0.0, 1.0], [9.0, 2.0]], [[20.0, 0.0], [31.0, 3.0]]])):
            centres = np.array([[5.0, 2.0], [25.0, 2.0]])
            for a, b in zip(partition._moments(grid, centres, children), partition._moments(distinct, centres, children)):
                assert np.allclose(a, b, rtol=1e-12, atol=1e-9)
