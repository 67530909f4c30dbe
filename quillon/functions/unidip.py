"""Clusters of one-dimensional samples as modal intervals (Maurus & Plant 2016), with tails and outliers.

All functions work on one sorted array and on half-open intervals of its ranks,
so a sample is sorted once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillon.functions.dip import dip_of_runs, dip_test, p_value_of, runs

Interval = tuple[int, int]


@dataclass(frozen=True)
class Sample:
    """A sorted sample with the level and the p-value function of its tests."""

    x: np.ndarray
    significance: float
    p_value: object = p_value_of
    size_factor: float = 2.0

    def test(self, a: int, b: int) -> tuple[bool, Interval]:
        """Whether ranks a to b are multimodal, and their modal interval (half-open)."""
        found = dip_test(self.x[a:b], True)
        return self.p_value(found.value, b - a) < self.significance, (a + found.interval[0], a + found.interval[1] + 1)

    def likeness(self, a: int, b: int) -> float:
        return self.p_value(dip_test(self.x[a:b], True).value, b - a)

    def mirrored(self, a: int, b: int) -> tuple[float, Interval]:
        """Larger dip of the sample mirrored at its start and at its end, and the modal interval folded back."""
        x = self.x[a:b]
        last = len(x) - 1
        at_start = dip_test(np.concatenate([2 * x[0] - x[:0:-1], x]), True)
        at_end = dip_test(np.concatenate([x, 2 * x[-1] - x[-2::-1]]), True)
        first = at_start.value > at_end.value
        found = at_start if first else at_end
        low, high = found.interval
        if low <= last < high:  # it spans both copies and cannot be folded
            low, high = dip_test(x, True).interval
        else:
            low, high = _folded(low, high, last, first)
        return found.value, (a + low, a + high + 1)


@dataclass(frozen=True)
class Counted(Sample):
    """The same of distinct values ``x`` with the ranks at which they start; ranks are those of the whole sample."""

    starts: np.ndarray | None = None

    def _cut(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.searchsorted(self.starts, a, side="right") - 1, np.searchsorted(self.starts, b)
        return self.x[i:j], np.clip(self.starts[i : j + 1], a, b) - a

    def at(self, rank: int) -> float:
        return float(self.x[np.searchsorted(self.starts, rank, side="right") - 1])

    def test(self, a: int, b: int) -> tuple[bool, Interval]:
        value, (low, high) = dip_of_runs(*self._cut(a, b))
        return self.p_value(value, b - a) < self.significance, (a + low, a + high + 1)

    def likeness(self, a: int, b: int) -> float:
        return self.p_value(dip_of_runs(*self._cut(a, b))[0], b - a)

    def mirrored(self, a: int, b: int) -> tuple[float, Interval]:
        x, starts = self._cut(a, b)
        n = np.diff(starts)
        back, last = n[::-1].copy(), b - a - 1
        back[-1] -= 1
        at_start = dip_of_runs(*runs(np.concatenate([2 * x[0] - x[::-1], x]), np.concatenate([back, n])))
        back[-1] += 1
        back[0] -= 1
        at_end = dip_of_runs(*runs(np.concatenate([x, 2 * x[-1] - x[::-1]]), np.concatenate([n, back])))
        first = at_start[0] > at_end[0]
        value, (low, high) = at_start if first else at_end
        if low <= last < high:
            low, high = dip_of_runs(x, starts)[1]
        else:
            low, high = _folded(low, high, last, first)
        return value, (a + low, a + high + 1)


def _folded(low: int, high: int, last: int, first: bool) -> Interval:
    """Ranks in a sample of the ranks in it and its mirror image, which stands first or behind."""
    if first:
        return (low - last, high - last) if low > last else (last - high, last - low)
    return (2 * last - high, 2 * last - low) if high > last else (low, high)


def modal_intervals(sample: Sample, start: int = 0, end: int | None = None) -> list[Interval]:
    """Intervals of the clusters among ranks start to end, in order.

    A multimodal range is narrowed to its modal interval until that is
    unimodal, or the whole range (of many equal values); then what is right and left of the cluster, tested together with
    it, is searched in turn, or widens it.  Neighbours whose union is unimodal
    are merged in the end.
    """
    end = len(sample.x) if end is None else end
    found: list[Interval] = []
    # (range, whether it is a search space of its own, that search space); right parts come first
    todo = [((start, end), True, (start, end))]
    while todo:
        (a, b), whole, space = todo.pop()
        multimodal, modal = sample.test(a, b)
        if multimodal and modal != (a, b):
            if modal[1] - modal[0] > 1:
                todo.append((modal, False, space))
            continue
        cluster = sample.mirrored(a, b)[1] if whole and not multimodal and b - a > 1 else (a, b)
        wide = list(cluster)
        for near, rest in (((cluster[0], space[1]), (cluster[1], space[1])), ((space[0], cluster[1]), (space[0], cluster[0]))):
            if rest[0] == rest[1]:
                continue
            if sample.test(*near)[0]:
                todo.append((rest, True, rest))
            else:
                folded = sample.mirrored(*near)[1]
                wide = [min(wide[0], folded[0]), max(wide[1], folded[1])]
        found.append((wide[0], wide[1]))
    return _merged(sample, sorted(found))


def _shortened(sample: Sample, left: Interval, right: Interval) -> Interval:
    """The union of two neighbours, of which the larger brings at most ``size_factor`` times the points of the smaller."""
    a = max(left[0], int(left[1] - sample.size_factor * (right[1] - right[0])))
    b = min(right[1], int(right[0] + sample.size_factor * (left[1] - left[0])))
    return a, b


def _merged(sample: Sample, clusters: list[Interval]) -> list[Interval]:
    """Inner clusters joined with the neighbour whose union with them is unimodal, the likelier one first."""
    k = 1
    while k < len(clusters) - 1:
        sides = [sample.likeness(*_shortened(sample, clusters[j], clusters[j + 1])) for j in (k - 1, k)]
        j = k - 1 if sides[0] >= sides[1] else k
        if max(sides) < sample.significance:
            k += 1
            continue
        clusters[j : j + 2] = [(clusters[j][0], clusters[j + 1][1])]
    return clusters


def with_tails(sample: Sample, clusters: list[Interval]) -> list[Interval]:
    """Clusters extended by structure of the gaps beside them, while a mirrored gap is multimodal."""
    clusters = list(clusters)
    for k in range(len(clusters) + 1):
        while True:
            a = clusters[k - 1][1] if k else 0
            b = clusters[k][0] if k < len(clusters) else len(sample.x)
            if b - a < 4 or sample.p_value(sample.mirrored(a, b)[0], 2 * (b - a) - 1) >= sample.significance:
                break
            inner = modal_intervals(sample, a, b)
            left = right = -1.0
            if k:
                first = inner[0]
                left = sample.likeness(max(clusters[k - 1][0], int(a - sample.size_factor * (first[1] - first[0]))), first[1])
            if k < len(clusters):
                last = inner[-1]
                right = sample.likeness(last[0], min(clusters[k][1], int(b + sample.size_factor * (last[1] - last[0]))))
            grown = False
            if right >= sample.significance and (len(inner) > 1 or right >= left):
                clusters[k], grown = (inner[-1][0], clusters[k][1]), True
            if left >= sample.significance and (len(inner) > 1 or left > right):
                clusters[k - 1], grown = (clusters[k - 1][0], inner[0][1]), True
            if not grown:
                break
    return clusters


def cuts(sample: Sample, clusters: list[Interval]) -> list[float]:
    """Values between neighbours: where the steps of a gap cross its chord nearest its middle, or the middle."""
    out = []
    for (_, a), (b, _) in zip(clusters, clusters[1:]):
        x = sample.x
        cut = (x[a - 1] + x[b]) / 2
        if b - a > 3 and x[b] != x[a]:
            under = (x[a:b] - x[a]) * (b - a) / (x[b] - x[a]) < np.arange(b - a)
            under[0], under[-1] = under[1], under[-2]
            change = np.flatnonzero(under[:-1] != under[1:])
            if len(change):
                cut = x[a + change[np.argmin(np.abs(x[a + change] - cut))] + 1]
        out.append(float(cut))
    return out


def unidip(values, significance: float = 0.05, add_tails: bool = False, outliers: bool = True, size_factor: float = 2.0, p_value=p_value_of) -> tuple[np.ndarray, list[Interval]]:
    """Labels in the order of ``values`` (-1 for outliers) and the clusters' intervals of ranks.

    Without ``outliers`` every point gets the label of a cluster beside it.
    """
    if not 0 <= significance <= 1:
        raise ValueError("a significance is between 0 and 1")
    values = np.asarray(values, float)
    order = np.argsort(values, kind="stable")
    sample = Sample(values[order], significance, p_value, size_factor)
    if not len(values):
        return np.empty(0, np.int64), []
    clusters = modal_intervals(sample)
    if add_tails:
        clusters = with_tails(sample, clusters)
    labels = np.full(len(values), -1)
    for k, (a, b) in enumerate(clusters):
        labels[order[a:b]] = k
    if not outliers:
        borders = cuts(sample, clusters)
        ranks = np.arange(len(values))
        free = labels[order] < 0
        nearest = np.searchsorted([b for _, b in clusters], ranks, side="right")  # clusters that end before
        for r in ranks[free]:
            k = int(nearest[r])
            if k in (0, len(clusters)):
                labels[order[r]] = min(k, len(clusters) - 1)
            else:
                labels[order[r]] = k - 1 if sample.x[r] < borders[k - 1] else k
    return labels, clusters


def counted_intervals(values: np.ndarray, counts: np.ndarray, significance: float = 0.05, size_factor: float = 2.0, p_value=p_value_of) -> list[tuple[float, float, int]]:
    """(first value, last value, size) of the clusters that :func:`unidip` finds, without tails, in a sample of sorted values with counts.

    Memory and time are those of the distinct values.
    """
    x, starts = runs(np.asarray(values, float), np.asarray(counts, np.int64))
    if not len(x):
        return []
    sample = Counted(x, significance, p_value, size_factor, starts)
    return [(sample.at(a), sample.at(b - 1), b - a) for a, b in modal_intervals(sample, 0, int(starts[-1]))]
