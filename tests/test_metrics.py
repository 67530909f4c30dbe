import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from quillon.operators import contingency as ct
from quillon.operators.geometry import cvnn_scores
from quillon.operators.preprocessing import TextMatrix, ZNormalizer, flatten_images, unflatten_images
from quillon.operators.validation import check_estimator, check_labels, check_points, check_same_points


def test_rearranged_confusion_matrices():
    #: Published matrices with the order of their columns.
    for matrix, order in (
        ([[0, 45, 3, 2], [0, 0, 0, 50], [30, 10, 5, 5], [5, 5, 35, 5]], [1, 3, 0, 2]),
        ([[0, 10, 45, 3, 2, 25], [0, 10, 0, 0, 50, 25], [30, 10, 10, 5, 5, 25], [5, 10, 5, 35, 5, 25]], [2, 4, 0, 3, 5, 1]),
        ([[0, 3, 2], [0, 0, 50], [30, 5, 5], [5, 35, 5]], [3, 2, 0, 1]),
    ):
        matrix = np.array(matrix)
        out, found = ct.rearrange(matrix)
        wide = np.pad(matrix, ((0, 0), (0, max(matrix.shape) - matrix.shape[1])))
        assert found.tolist() == order and (out == wide[:, order]).all()
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.integers(0, 9, (rng.integers(1, 5), rng.integers(1, 5)))
        out, _ = ct.rearrange(m)
        wide = np.pad(m, ((0, 0), (0, max(m.shape) - m.shape[1])))
        assert out.trace() == max(sum(wide[i, p[i]] for i in range(len(m))) for p in itertools.permutations(range(wide.shape[1]), len(m)))


def test_confusion_matrix_of_labels(spark):
    rows = [(0, 5), (0, 5), (1, 6), (2, 6), (2, 7), (3, 7)]
    cm = ct.confusion_matrix(ct.contingency(spark.createDataFrame(rows, "t int, p int"), "t", "p"))
    assert cm.true == (0, 1, 2, 3) and cm.pred == (5, 6, 7) and cm.matrix.tolist() == [[2, 0, 0], [0, 1, 0], [0, 1, 1], [0, 0, 1]]
    assert cm.square().pred == (5, 6, 7, -2) and cm.rearranged().matrix.shape == (4, 4)
    assert cm.table(spark).count() == 12
    assert ct.clustering_accuracy(ct.contingency(spark.createDataFrame(rows, "t int, p int"), "t", "p")) == pytest.approx(4 / 6)


#: Published labelings.
TRUE = ([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 1, 2, 0, 1, 2, 0, 1, 2], [0] * 9)
PRED = ([0, 0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 1, 2, 2, 3, 3, 4], [0] * 9)


def test_pairs_of_several_labelings(spark):
    df = spark.createDataFrame(list(zip(*TRUE, *PRED)), "t0 int, t1 int, t2 int, p0 int, p1 int, p2 int")
    names = ["t0", "t1", "t2"], ["p0", "p1", "p2"]
    assert tuple(ct.multi_labeling_pair_counts(df, *names).first()) == (36, 0, 0, 0)
    assert tuple(ct.multi_labeling_pair_counts(df, *names, remove_noise_spaces=True).first()) == (11, 6, 7, 12)
    score = ct.multi_labeling_pair_scores(df, *names).first()
    assert [score[c] for c in ("jaccard", "rand", "precision", "recall")] == pytest.approx([11 / 24, 23 / 36, 11 / 17, 11 / 18], abs=1e-6)
    rng = random.Random(4)
    rows = [tuple(rng.choice([0, 1, 2, None]) for _ in range(4)) for _ in range(60)]
    got = ct.multi_labeling_pair_counts(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["a", "b"], ["c", "d"]).first()
    same = lambda x, y, cols: any(x[k] is not None and x[k] == y[k] for k in cols)
    want = Counter((same(x, y, (0, 1)), same(x, y, (2, 3))) for x, y in itertools.combinations(rows, 2))
    assert tuple(got) == (want[True, True], want[False, True], want[True, False], want[False, False])


def test_pair_counts_are_exact_for_huge_groups(spark):
    n = 3_000_000_000
    cells = spark.createDataFrame([(0, 0, n), (1, 1, 5)], "true int, pred int, n long")
    assert ct.pair_counts(cells).first()["tp"] == n * (n - 1) // 2 + 10


def test_cvnn_of_several_labelings(spark):
    #: A published example.
    x = [[0, 0], [0, 1], [1, 0], [1, 1], [5, 5], [4, 5], [5, 4], [4, 4]]
    labelings = list(zip([0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1, 0, 0]))
    df = spark.createDataFrame([(k, [float(v) for v in p], *ab) for k, (p, ab) in enumerate(zip(x, labelings))], "id long, features array<double>, a int, b int")
    found = cvnn_scores(df, ["a", "b"], 4)
    assert found[1] == pytest.approx(2.0) and 0 < found[0] < 2


def test_checks(spark):
    points = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, features array<double>")
    assert check_points(points) == (2, 2)
    for rows in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, [float("nan")])], [(0, [1.0]), (0, [2.0])], [(None, [1.0])], [(0, [float("inf")])], [(0, [])], [(0, None)], []):
        with pytest.raises(ValueError):
            check_points(spark.createDataFrame(rows, "id long, features array<double>"))
    labels = spark.createDataFrame([(0, 1), (1, None)], "id long, cluster int")
    assert check_labels(labels, ["id"]) == 2 and check_same_points(points, labels) == 2
    for bad in (lambda: check_labels(labels, ["cluster"]), lambda: check_labels(labels, ["x"]), lambda: check_same_points(points, labels.limit(1)), lambda: check_points(points.drop("id"))):
        with pytest.raises(ValueError):
            bad()
    check_estimator(lambda p: p.selectExpr("id", "cast(id as int) as cluster"), points)
    with pytest.raises(ValueError):
        check_estimator(lambda p: p.selectExpr("id", "-5 as cluster"), points)


def test_normaliser_and_images(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 2, (50, 3)) * [1, 2, 0]
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>").repartition(4)
    for by in (False, True):
        model = ZNormalizer.fit(points, by)
        z = np.array([r["features"] for r in model.transform(points).orderBy("id").collect()])
        want = (x - (x.mean(0) if by else x.mean())) / (np.where(x.std(0) > 0, x.std(0), 1) if by else x.std())
        assert np.allclose(z, want, atol=1e-6)
        back = np.array([r["features"] for r in model.inverse_transform(model.transform(points)).orderBy("id").collect()])
        assert np.allclose(back, x)
    image = np.arange(24).reshape(2, 4, 3)
    df = spark.createDataFrame([(0, image.tolist())], "id long, image array<array<array<long>>>")
    flat = flatten_images(df, "HWC")
    assert flat.first()["features"] == image.transpose(2, 0, 1).ravel().tolist()
    assert flatten_images(df, "CHW").first()["features"] == list(range(24))
    assert np.array(unflatten_images(flat, (3, 2, 4)).first()["image"]).tolist() == image.tolist()
    assert unflatten_images(spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "features array<double>"), (2, 2)).first()["image"] == [[1, 2], [3, 4]]


def test_text_matrix(spark):
    texts = ["The cats are running", "A cat runs, über die Straße", "dogs and cats", None, "dog dog dog straße"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = TextMatrix.fit(docs, tfidf=False, stemming=False)
    assert plain.terms == ("cat", "cats", "die", "dog", "dogs", "running", "runs", "straße", "über")
    rows = {r["id"]: r["features"] for r in plain.transform(docs).collect()}
    assert rows[4][3] == 3 and rows[3] == [0.0] * 9 and sum(rows[0]) == 2
    stemmed = TextMatrix.fit(docs, min_df=2)
    assert set(stemmed.terms) == {"cat", "dog", "straße"}
    rows = {r["id"]: r["features"] for r in stemmed.transform(docs).collect()}
    at = stemmed.terms.index("dog")
    w = [3 * (math.log(6 / 3) + 1), math.log(6 / 3) + 1]
    assert rows[4][at] == pytest.approx(w[0] / math.hypot(*w)) and math.hypot(*rows[2]) == pytest.approx(1)
    assert len(TextMatrix.fit(docs, max_features=2).terms) == 2 and TextMatrix.fit(docs, max_df=0.2, stemming=False).terms.count("cats") == 0
