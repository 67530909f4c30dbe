import numpy as np
import pytest

from quillon.functions.dip import DipTable, boot_p_value, critical_values, dip, dip_test, gradient, p_value_gradient, p_value_of
from quillon.functions.unidip import Sample, unidip

#: A published sample with its hulls.
SAMPLE = [-2, 0, 0.25, 0.5, 1, 1.1, 1.2, 1.3, 1.4, 1.5, 2, 3, 4, 4.5]


def test_hulls_and_triangle_of_a_published_sample():
    found = dip_test(SAMPLE)
    assert found.value == pytest.approx(0.0535714, abs=1e-7)
    assert found.interval == (4, 9) and found.triangle == (1, 3, 4)
    assert found.gcm == (9, 5, 4, 1, 0) and found.lcm == (4, 8, 9, 10, 13)
    assert found.below.tolist() == [0, 0, 1, 1, 1, 4, 5, 5, 7, 5, 4, 4, 1, 1]
    assert found.above.tolist() == [9, 9, 9, 9, 8, 6, 8, 8, 9, 10, 13, 13, 13, 13]


def test_small_and_even_samples():
    assert dip([1] * 10 + [2] * 10)[0] == 0.25 and dip([1] * 20)[0] == 0
    assert dip([1, 2, 3, 4])[0] == 0 and dip(range(1, 9))[0] == 0 and dip([5, 1])[0] == 0
    assert dip([1, 1, 1, 2, 2, 2, 2, 2, 2.5, 2.5, 2.5])[0] == pytest.approx(0.1363636, abs=1e-7)
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.normal(size=rng.integers(4, 40))
        d = dip(x)[0]
        assert 0 <= d <= 0.25 and dip(-x)[0] == pytest.approx(d) and dip(3 * x + 7)[0] == pytest.approx(d)


def test_gradients_follow_differences():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(3, 1, (40, 3))])
    axis = np.array([0.8, 0.5, 0.3])

    def at(v):
        p = points @ v
        order = np.argsort(p)
        return dip_test(p[order], True), p, order

    found, p, order = at(axis)
    slope = gradient(points, p, order, found.triangle)
    slope_p = p_value_gradient(points, p, order, found.triangle, found.value)
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        up, down = at(axis + step)[0].value, at(axis - step)[0].value
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)
        assert slope_p[k] == pytest.approx((p_value_of(up, 80) - p_value_of(down, 80)) / 2e-6, abs=1e-3)


def test_p_values_of_table_function_and_bootstrap(spark):
    rows = critical_values(spark, (10, 50), boots=400).collect()
    table = DipTable(rows)
    for n, d in ((10, 0.1), (50, 0.06), (30, 0.08)):
        p = p_value_of(d, n)
        assert abs(p - boot_p_value(spark, d, n, 400)) < 0.1 and abs(p - table.p_value(d, n)) < 0.12
    assert table.p_value(0.2, 3) == 1 and table.p_value(0.2, 10**6) == p_value_of(0.2, 10**6) and table.p_value(0.25, 50) == 0


def test_unidip_finds_blobs_in_noise():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, 300), rng.normal(5, 0.3, 300), rng.normal(10, 0.3, 300), rng.uniform(-3, 13, 60)])
    labels, clusters = unidip(x)
    assert len(clusters) == 3
    for k in range(3):
        own = labels[300 * k : 300 * (k + 1)]
        assert np.bincount(own[own >= 0]).argmax() == k and (own == k).mean() > 0.5
    full, same = unidip(x, add_tails=True, outliers=False)
    assert len(same) == 3 and (full >= 0).all()
    assert all((full[300 * k : 300 * (k + 1)] == k).mean() > 0.95 for k in range(3))
    assert len(unidip(rng.normal(size=500))[1]) == 1 and unidip([])[1] == []


def test_mirroring_keeps_ranks_inside():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.sort(rng.normal(size=rng.integers(5, 60)))
        value, (a, b) = Sample(x, 0.05).mirrored(0, len(x))
        assert 0 <= a < b <= len(x) and 0 <= value <= 0.25


def test_counted_values_give_the_dip_and_clusters_of_the_whole_sample():
    """Equal values as one run: the same dip, modal interval and clusters, in the memory of the distinct values."""
    import tracemalloc

    from quillon.functions.dip import dip_of_runs, dip_test, runs
    from quillon.functions.unidip import counted_intervals

    rng = np.random.default_rng(11)
    for k in range(300):
        n = int(rng.integers(1, 120))
        x = np.sort(np.round(np.where(rng.random(n) < 0.5, rng.normal(size=n), rng.normal(4, 0.5, size=n)), int(rng.integers(0, 3))))
        found = dip_test(x, True)
        assert dip_of_runs(*runs(*np.unique(x, return_counts=True))) == (found.value, found.interval)
    for decimals in (0, 1, 2, 9):
        x = np.sort(np.round(np.concatenate([rng.normal(c, 0.4, 300) for c in (0, 5, 9)] + [rng.uniform(-3, 12, 200)]), decimals))
        whole = [(x[a], x[b - 1], b - a) for a, b in unidip(x)[1]]
        assert counted_intervals(*np.unique(x, return_counts=True)) == whole and whole
    assert len(unidip([0.0] * 500 + [1.0] * 500)[1]) == 1  # its modal interval is the whole range
    values, counts = np.arange(1000) / 10, np.full(1000, 100_000)
    tracemalloc.start()
    assert counted_intervals(values, counts)
    assert tracemalloc.get_traced_memory()[1] < 5e6
    tracemalloc.stop()
