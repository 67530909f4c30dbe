import numpy as np
import pytest

from quillon.operators import geometry as geo
from quillon.operators.dctree import forest, spanning_tree, tile_tree
from quillon.operators.density import density_peaks
from quillon.operators.spectral import radius_graph, radius_graph_degrees


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row], k % 3) for k, row in enumerate(x)], "id long, features array<double>, label int")


def plain(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def test_points_travel_once_for_each_stripe(spark, monkeypatch):
    """Twice as many points make twice as many rows: they meet in stripes, not in blocks."""
    monkeypatch.setattr(geo, "BLOCK", 4)
    rows = [geo.tiles(table(spark, np.zeros((n, 2)))).rows.count() for n in (200, 400)]
    assert rows[0] == 200 * (2 * geo.SIDE - 1) and rows[1] == 2 * rows[0]
    halves = geo.tiles(table(spark, np.zeros((400, 2))), half=True).rows.count()
    assert halves == 400 * geo.SIDE
    kept = geo.per_tile_of_stripes(geo.tiles(table(spark, np.zeros((400, 2)))), lambda a, b: iter(()), "i long")
    assert kept.count() == 0


@pytest.mark.parametrize("block", [3, 256])
def test_operators_with_many_copies(spark, monkeypatch, block):
    """Equal points, near ones far from the origin, and ties: as plain distances have them."""
    monkeypatch.setattr(geo, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = np.concatenate([np.round(rng.normal(size=(40, 3)), 1), np.full((30, 3), 0.5), 1e4 + rng.normal(size=(10, 3)) * 1e-4])
    points, d = table(spark, x), plain(x)
    got = {}
    for r in geo.nearest(points, 6).collect():
        got.setdefault(r["i"], {})[r["rank"]] = (r["j"], r["d"])
    for i in range(len(x)):
        want = sorted((d[i][j], j) for j in range(len(x)) if j != i)[:6]
        assert [got[i][k + 1][0] for k in range(6)] == [j for _, j in want]
        assert [got[i][k + 1][1] for k in range(6)] == pytest.approx([v for v, _ in want], rel=1e-12)
    same = np.arange(len(x)) % 3
    for r in geo.label_pair_sums(points).collect():
        own = d[np.ix_(same == r["label"], same == r["label"])][np.triu_indices(int((same == r["label"]).sum()), 1)]
        assert (r["pairs"], r["total"], r["longest"]) == (len(own), pytest.approx(own.sum(), rel=1e-10), pytest.approx(own.max(), rel=1e-10))
    radius = float(d[0, 5])  # a distance itself: the pair is within
    assert {r["i"]: r["degree"] for r in geo.degrees(points, radius).collect()} == {i: int((d[i] <= radius + 1e-13).sum()) - 1 for i in range(len(x))}
    assert geo.pair_distances(points).count() == 80 * 79


def test_tile_trees_are_the_forests_of_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 2)), 1)
    core, ids, d = np.sort(plain(x), axis=1)[:, 3], rng.permutation(60), plain(x)
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    for split in (None, 25):
        i, j = np.triu_indices(60, 1)
        held = np.ones(len(i), bool) if split is None else (i < split) & (j >= split)
        i, j = i[held], j[held]
        kept = forest(ids[i], ids[j], np.round(w[i, j], 12))
        want = {(min(ids[i[e]], ids[j[e]]), max(ids[i[e]], ids[j[e]])) for e in kept}
        u, v, weights = tile_tree(x, core, ids, split)
        assert len(u) == 59 and weights.sum() == pytest.approx(w[i, j][kept].sum())
        assert len({(min(a, b), max(a, b)) for a, b in zip(ids[u].tolist(), ids[v].tolist())} & want) > 50
    monkeypatch.setattr("quillon.operators.dctree.PRIM", 16)
    assert sorted(r["w"] for r in spanning_tree(table(spark, x), 4).collect()) == pytest.approx(sorted(tile_tree(x, core, ids)[2]))


def test_features_of_single_precision_travel_as_they_are(spark):
    """Half the bytes of a point in the tiles, and the distances that the doubles of the same numbers have."""
    x = np.random.default_rng(2).normal(size=(30, 4)).astype(np.float32).astype(float)
    doubles = table(spark, x)
    singles = doubles.selectExpr("id", "cast(features as array<float>) as features", "label")
    assert geo.tiles(singles, half=True).rows.schema["f"].dataType.simpleString() == "array<float>"
    assert geo.tiles(doubles, half=True).rows.schema["f"].dataType.simpleString() == "array<double>"
    want = {(r["i"], r["j"]): r["reach"] for r in geo.reachability(doubles, 4).collect()}
    assert {(r["i"], r["j"]): r["reach"] for r in geo.reachability(singles, 4).collect()} == want and len(want) == 30 * 29 / 2


def test_trees_of_parts_do_not_deal_points_more_often(spark, monkeypatch):
    """The points of a tree travel for each stripe, however small the parts are that a task takes at once."""
    monkeypatch.setattr("quillon.operators.dctree.PRIM", 8)
    dealt = []
    plain_tiles = geo.tiles

    def tiles(*args, **options):
        found = plain_tiles(*args, **options)
        if "core" in found.rows.columns:
            dealt.append(found.rows.count())
        return found

    monkeypatch.setattr(geo, "tiles", tiles)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(270, 3)), np.zeros((20, 3)), np.round(rng.normal(size=(10, 3)))])
    core = np.sort(plain(x), axis=1)[:, 3]
    w = np.maximum(plain(x), np.maximum(core[:, None], core[None]))
    i, j = np.triu_indices(300, 1)
    want = w[i, j][forest(i, j, w[i, j])]
    assert sorted(r["w"] for r in spanning_tree(table(spark, x), 4).collect()) == pytest.approx(sorted(want), rel=1e-12)
    assert dealt == [2 * 300]


def only_halves(monkeypatch):
    plain_tiles = geo.tiles

    def tiles(*args, **options):
        assert options.get("half"), "each pair is to be met once"
        return plain_tiles(*args, **options)

    monkeypatch.setattr(geo, "tiles", tiles)


@pytest.mark.parametrize("block", [5, 256])
def test_density_peaks_meet_each_pair_once(spark, monkeypatch, block):
    """Copies, ties and far points, as plain distances have them."""
    monkeypatch.setattr(geo, "BLOCK", block)
    only_halves(monkeypatch)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.normal(size=(50, 3)), 1), np.full((12, 3), 0.5), 30 + rng.normal(size=(8, 3)) * 1e-3])
    n, d = len(x), plain(x)
    radius = 0.3 * d[np.triu_indices(n, 1)].mean()
    rho = np.round(np.exp(-((d / radius) ** 2)).sum(axis=1) - 1, 9)
    got = {r["id"]: r for r in density_peaks(table(spark, x), 0.3).collect()}
    assert len(got) == n
    for i in range(n):
        denser = [j for j in range(n) if rho[j] > rho[i] + 1e-12 or abs(rho[j] - rho[i]) < 1e-12 and j < i]
        want = min(((geo.row_distances(x[i], x[j : j + 1])[0], j) for j in denser), default=(d[i].max(), None))
        assert got[i]["rho"] == pytest.approx(rho[i], abs=2e-9)
        assert (got[i]["delta"], got[i]["parent"]) == (pytest.approx(want[0], rel=1e-12), want[1])
    same = table(spark, np.ones((4, 2)))
    assert sorted((r["rho"], r["delta"]) for r in density_peaks(same).collect()) == [(3.0, 0.0)] * 4


@pytest.mark.parametrize("block,stripe", [(3, 20), (256, 1 << 15)])
def test_radius_degrees_and_neighbours_meet_each_pair_once(spark, monkeypatch, block, stripe):
    """Copies and ties, within a stripe and across, as the edges of the graph have them; no edge leaves a tile."""
    monkeypatch.setattr(geo, "BLOCK", block)
    monkeypatch.setattr(geo, "STRIPE", stripe)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.normal(size=(60, 3)), 1), np.full((15, 3), 0.5), [[40.0, 0, 0]]])
    points, n, d = table(spark, x), len(x), plain(x)
    edges = {}
    for r in radius_graph(points, 4, 0.9).collect():
        edges.setdefault(r["i"], []).append(r["w"])
    only_halves(monkeypatch)
    got = {r["i"]: (r["degree"], r["total"]) for r in radius_graph_degrees(points, 4, 0.9).collect()}
    assert got == {i: (len(w), pytest.approx(sum(w))) for i, w in edges.items()} and 0 < len(got) < n
    near = {(r["i"], r["rank"]): r["j"] for r in geo.nearest(points, 7).collect()}
    for i in range(n):
        order = sorted((geo.row_distances(x[i], x[j : j + 1])[0], j) for j in range(n) if j != i)
        assert [near[i, k + 1] for k in range(7)] == [j for _, j in order[:7]]
