import numpy as np
import pytest

from quillon.operators import geometry as geo
from quillon.operators.dctree import DCTree, dc_tree, forest, spanning_tree, with_labels
from quillon.operators.density import density_peak_clusters, density_peaks, diana, divide, grow_by_density, multi_density_dbscan, splinter
from quillon.operators.trees import ClusterTree


def table(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in np.atleast_1d(p)]) for k, p in enumerate(x)], "id long, features array<double>")


#: A published line of six points.
LINE = [[0, 0], [-3, 0], [2, 0], [3, 0], [-7, 0], [-8, 0]]


def test_tree_of_six_points(spark):
    tree = dc_tree(table(spark, LINE), 3)
    assert tree.root.dist == 5 and tree.labels_for_k(3).tolist() == [2, 2, 2, 2, 1, 0]
    assert tree.eps_for_k(3) == pytest.approx(4, abs=1e-5)
    assert tree.leaves(tree.root.right) == [5] and tree.root.left.dist == 4
    want = [[0, 4, 3, 3, 4, 5], [4, 0, 4, 4, 4, 5], [3, 4, 0, 3, 4, 5], [3, 4, 3, 0, 4, 5], [4, 4, 4, 4, 0, 5], [5, 5, 5, 5, 5, 0]]
    assert tree.dc_distances().tolist() == want
    assert [[tree.dc_dist(i, j) for j in range(6)] for i in range(6)] == want
    assert tree.dc_distances(range(6), [4, 3]).tolist() == [[r[4], r[3]] for r in want]
    two = dc_tree(table(spark, LINE), 2)
    assert two.root.dist == 4 and two.labels_for_k(3).tolist() == [2, 1, 2, 2, 0, 0] and two.eps_for_k(3) == pytest.approx(3, abs=1e-5)
    assert tree.table(spark).where("parent is null").count() == 1
    with pytest.raises(ValueError):
        dc_tree(table(spark, LINE), 7)


def prim(d):
    inside, weights = {0}, []
    while len(inside) < len(d):
        w, j = min((d[i][j], j) for i in inside for j in range(len(d)) if j not in inside)
        inside.add(j)
        weights.append(w)
    return sorted(weights)


def test_spanning_tree_equals_prim(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(40, 2)), 1)  # with ties
    plain = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert sorted(r["w"] for r in spanning_tree(table(spark, x)).collect()) == pytest.approx(prim(plain))
    core = np.sort(plain, axis=1)[:, 3]
    reach = np.maximum(plain, np.maximum(core[:, None], core[None]))
    edges = spanning_tree(table(spark, x), 4).collect()
    assert sorted(r["w"] for r in edges) == pytest.approx(prim(reach))
    got = {(r["i"], r["j"]): r["reach"] for r in geo.reachability(table(spark, x), 4).collect()}
    assert len(got) == 40 * 39 // 2 and all(got[i, j] == pytest.approx(reach[i, j]) for i, j in got)


def test_tiles_equal_plain_distances(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 5)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(23, 2)), 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    points = table(spark, x)
    for r in geo.nearest(points, 3).collect():
        order = sorted((d[r["i"]][j], j) for j in range(23) if j != r["i"])
        assert order[r["rank"] - 1] == (pytest.approx(r["d"]), r["j"])
    assert {r["i"]: r["degree"] for r in geo.degrees(points, 1.0).collect()} == {i: int((d[i] <= 1).sum()) - 1 for i in range(23)}
    assert geo.mean_distance(points) == pytest.approx(d[np.triu_indices(23, 1)].mean())


def plain_stable(tree):
    """Stable clusters by recursion over sets of points, as (distance, points, parts)."""

    def condense(node):
        if node is None or node.size < tree.min_points:
            return None
        a, b = condense(node.left), condense(node.right)
        split = node.left is not None and node.left.size >= tree.min_points and node.right.size >= tree.min_points
        if split and (a is None) == (b is None):
            return node.dist, tree.leaves(node), [x for x in (a, b) if x]
        one = a or b
        return one if split or one is None else (one[0], tree.leaves(node), one[2])

    def stable(part, above):
        own = 0.0 if above is None else (1 / part[0] - 1 / above) * len(part[1])
        below = [stable(x, part[0]) for x in part[2]]
        total = sum(s for s, _ in below)
        return (own, [part[1]]) if own >= total else (total, [x for _, xs in below for x in xs])

    return stable(condense(tree.root), None)[1]


def test_stable_clusters_equal_recursion(spark):
    rng = np.random.default_rng(0)
    several = 0
    for trial in range(4):
        x = np.concatenate([rng.normal((c + side, 0), 0.1 + 0.1 * side, (20, 2)) for c in (0, 5, 20) for side in (0, 1)])
        points = table(spark, x)
        tree = dc_tree(points, 3 + trial)
        labels = tree.stable_labels()
        want = plain_stable(tree)
        several += len(want) > 1
        assert sorted(sorted(w) for w in want) == sorted(np.flatnonzero(labels == k).tolist() for k in range(len(want)))
    assert several
    assert with_labels(points, tree, labels).count() == 120
    assert DCTree([0, 1], [(0, 1, 0.0)], 5).stable_labels().tolist() == [0, 0]
    assert forest(np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([1.0, 2.0, 1.5])).tolist() == [0, 2]


def test_density_growth(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 1.0, (60, 2)), [[20, 20]]])
    got = {r["id"]: r["cluster"] for r in multi_density_dbscan(table(spark, x), 10, 2.5, 5).collect()}
    a, b = [got[k] for k in range(60)], [got[60 + k] for k in range(60)]
    assert max(map(a.count, set(a))) > 55 and max(map(b.count, set(b))) > 45 and max(set(a), key=a.count) != max(set(b), key=b.count)
    assert got[120] == -1
    labels, means = grow_by_density(np.array([1, 1.5, 9, 1.2]), np.array([[1, 2], [0, 3], [3, 0], [1, 2]]), 2.0, 2)
    assert labels.tolist() == [0, 0, -1, 0] and means == [pytest.approx((1 + 1.5 + 1.2) / 3)]
    with pytest.raises(ValueError):
        multi_density_dbscan(table(spark, x[:5]), 10)


def test_density_peaks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    radius = 0.1 * d[np.triu_indices(len(d), 1)].mean()
    rho = np.exp(-((d / radius) ** 2)).sum(1) - 1
    for r in density_peaks(table(spark, x)).collect():
        assert r["rho"] == pytest.approx(rho[r["id"]], abs=1e-8)
        up = [j for j in range(len(x)) if rho[j] > rho[r["id"]]]
        assert r["delta"] == pytest.approx(d[r["id"]][up].min() if up else d[r["id"]].max())
    found, k = density_peak_clusters(table(spark, x))
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert k == 3 and [len({got[40 * c + j] for j in range(40)}) for c in range(3)] == [1, 1, 1]


#: A published matrix of five distances.
FIVE = [[0, 2, 6, 10, 9], [2, 0, 5, 9, 8], [6, 5, 0, 4, 5], [10, 9, 4, 0, 3], [9, 8, 5, 3, 0]]


def test_divisive_analysis(spark):
    d = np.array(FIVE, float)
    assert splinter(d).tolist() == [True, True, False, False, False]
    assert splinter(d[2:, 2:]).tolist() == [True, False, False]
    labels, tree = divide(d, 3)
    assert labels.tolist() == [1, 1, 2, 0, 0]
    full, tree = divide(d, None, 0, True)
    assert len(set(full)) == 5 and len(tree.leaf) == 5
    assert divide(d, None, 5.0)[0].tolist() == [1, 1, 2, 0, 0]
    got, tree = diana(table(spark, [[0.0], [0.1], [9.0], [9.2]]), 2)
    assert [r["cluster"] for r in got.orderBy("id").collect()] in ([0, 0, 1, 1], [1, 1, 0, 0])


def test_cluster_tree_edits():
    tree = ClusterTree()
    for c in (0, 0, 0, 1, 1):
        tree.split(c)
    assert sorted(tree.leaf) == [0, 1, 2, 3, 4, 5]
    assert tree.labels_below("r1") == [1, 4, 5] and tree.lowest_common_ancestor(0, 2) == "r0"
    leaves, inner = tree.leaf_and_split_nodes()
    assert len(leaves) == 6 and len(inner) == 5
    merges = tree.linkage()
    assert len(merges) == 5 and merges[-1][3] == 6
    assert tree.prune(3) == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 1} and sorted(tree.leaf) == [0, 1, 2]
    tree.delete(tree.leaf[2])
    assert sorted(tree.leaf.values()) == ["r0", "r1"] and len(tree.parent) == 3
    with pytest.raises(ValueError):
        tree.split(9)
