"""Comparing two labelings: relational plans over their contingency table.

The table (true, pred, n) has one row for each pair of labels that occurs, made
by one aggregation with map-side combining; every score below is computed from
it and its margins, so the points themselves are shuffled never.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n): how many points have each pair of labels."""
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _margins(cells: DataFrame) -> DataFrame:
    """Cells with their row sum a, column sum b and the number of points."""
    rows = cells.groupBy("true").agg(F.sum("n").alias("a"))
    columns = cells.groupBy("pred").agg(F.sum("n").alias("b"))
    total = cells.agg(F.sum("n").alias("total"))
    return cells.join(rows, "true").join(columns, "pred").crossJoin(F.broadcast(total))


def _double(value, name: str):
    return F.round(value, 6).cast("double").alias(name)


def purity(cells: DataFrame) -> DataFrame:
    """Share of the points that belong to the majority class of their cluster."""
    best = cells.groupBy("pred").agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return best.agg(_double(F.sum("best") / F.sum("size"), "purity"))


def _pairs(n):
    """n (n - 1) / 2 as an exact integer of 38 digits."""
    wide = n.cast("decimal(19,0)")
    return (wide * (wide - F.lit(1).cast("decimal(19,0)")) / F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")


def pair_counts(cells: DataFrame) -> DataFrame:
    """Pairs of points together in both, one or neither of the labelings, in closed form and in exact integers."""
    two = lambda x: F.sum(_pairs(x))
    both = cells.agg(two(F.col("n")).alias("tp"), F.sum("n").alias("m"))
    rows = cells.groupBy("true").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("in_true"))
    columns = cells.groupBy("pred").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("in_pred"))
    one = both.crossJoin(rows).crossJoin(columns)
    return one.select(
        F.col("tp").cast("long").alias("tp"),
        (F.col("in_pred") - F.col("tp")).cast("long").alias("fp"),
        (F.col("in_true") - F.col("tp")).cast("long").alias("fn"),
        (_pairs(F.col("m")) - F.col("in_true") - F.col("in_pred") + F.col("tp")).cast("long").alias("tn"),
    )


def pair_scores(counts: DataFrame) -> DataFrame:
    """Jaccard, Rand, precision, recall and F1 of counted pairs; 0 where nothing is counted."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    share = lambda a, b, name: _double(F.when(b == 0, 0.0).otherwise(a / b), name)
    return counts.select(share(tp, tp + fp + fn, "jaccard"), share(tp + tn, tp + fp + fn + tn, "rand"), share(tp, tp + fp, "precision"), share(tp, tp + fn, "recall"), share(2 * tp, 2 * tp + fp + fn, "f1"))


def variation_of_information(cells: DataFrame) -> DataFrame:
    r, p, q = F.col("n") / F.col("total"), F.col("a") / F.col("total"), F.col("b") / F.col("total")
    return _margins(cells).agg(_double(-F.sum(r * (F.log(r / p) + F.log(r / q))), "vi"))


def mutual_information(cells: DataFrame) -> DataFrame:
    """NMI (arithmetic mean of entropies) and its variant that punishes a wrong number of clusters."""
    n, a, b, m = map(F.col, ("n", "a", "b", "total"))
    mi = _margins(cells).agg(F.sum(n / m * F.log(n * m / (a * b))).alias("mi"), F.first(m).alias("m"))
    entropy = lambda key, name: cells.groupBy(key).agg(F.sum("n").alias("c")).crossJoin(F.broadcast(cells.agg(F.sum("n").alias("m")))).agg((-F.sum(F.col("c") / F.col("m") * F.log(F.col("c") / F.col("m")))).alias(f"h_{name}"), F.count("*").alias(f"k_{name}"))
    one = mi.crossJoin(entropy("true", "t")).crossJoin(entropy("pred", "p"))
    mean = (F.col("h_t") + F.col("h_p")) / 2
    nmi = F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean)
    return one.select(_double(nmi, "nmi"), _double(nmi * F.exp(-F.abs(F.col("k_t") - F.col("k_p")) / F.col("k_t")), "fnmi"))


def dom(cells: DataFrame) -> DataFrame:
    """Dom's measure: conditional entropy plus the cost of the tables, and the same scaled to 0..1."""
    cost = lambda h: F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.col("c") - 1, F.lit(1))), lambda i: F.when(i < F.col("c"), F.log((h + i) / i)).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    size = cells.agg(F.sum("n").alias("m"), F.count_distinct("true").cast("int").alias("c"))
    columns = cells.groupBy("pred").agg(F.sum("n").alias("h"))
    conditional = cells.join(columns, "pred").agg((-F.sum(F.col("n") * F.log(F.col("n") / F.col("h")))).alias("s"))
    tables = columns.crossJoin(F.broadcast(size)).agg(F.sum(cost(F.col("h"))).alias("t"))
    classes = cells.groupBy("true").agg(F.sum("n").alias("a")).crossJoin(F.broadcast(size))
    of_class = classes.agg((-F.sum(F.col("a") / F.col("m") * F.log(F.col("a") / F.col("m")))).alias("h_c"), (F.sum(cost(F.col("a"))) / F.first("m")).alias("least"))
    one = conditional.crossJoin(tables).crossJoin(of_class).crossJoin(size)
    q0 = (F.col("s") + F.col("t")) / F.col("m")
    most = F.col("h_c") + F.log("c")
    return one.select(_double(q0, "dom"), _double((most - q0) / (most - F.col("least")), "dom_scaled"))


def best_assignment(gain: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of the largest total gain (shortest augmenting paths with potentials)."""
    rows, columns = gain.shape
    size = max(rows, columns)
    cost = np.zeros((size, size))
    cost[:rows, :columns] = -gain
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match = np.full(size + 1, -1)
    for row in range(size):
        match[size] = row
        at, low, came, done = size, np.full(size, np.inf), np.full(size, size), np.zeros(size + 1, bool)
        while match[at] >= 0:
            done[at] = True
            open_ = ~done[:size]
            reduced = cost[match[at]] - u[match[at]] - v[:size]
            better = open_ & (reduced < low)
            low[better], came[better] = reduced[better], at
            step_to = int(np.argmin(np.where(open_, low, np.inf)))
            delta = low[step_to]
            u[match[done]] += delta
            v[done] -= delta
            low[open_] -= delta
            at = step_to
        while at != size:
            match[at] = match[came[at]]
            at = came[at]
    out = np.full(size, -1)
    out[match[:size]] = np.arange(size)
    return out[:rows]


def clustering_accuracy(cells: DataFrame, limit: int = 4000) -> float:
    """Largest share of points whose cluster is matched with their class, one to one.

    The label grid is gathered; more than ``limit`` labels on a side are refused.
    """
    if max(cells.select("true").distinct().limit(limit + 1).count(), cells.select("pred").distinct().limit(limit + 1).count()) > limit:
        raise ValueError(f"more than {limit} labels")
    gain = confusion_matrix(cells).matrix
    found = best_assignment(gain)
    return float(sum(gain[i, j] for i, j in enumerate(found) if j < gain.shape[1]) / gain.sum())


@dataclass(frozen=True)
class ConfusionMatrix:
    """Counts of each (true, predicted) label; labels are sorted, missing ones of a square matrix are ``PAD``."""

    true: tuple
    pred: tuple
    matrix: np.ndarray

    def rearranged(self) -> ConfusionMatrix:
        """Columns ordered so that the diagonal sum is largest, the rest by their largest entry; padded where there are fewer."""
        matrix, order = rearrange(self.matrix)
        pred = [*self.pred, *[PAD] * (max(self.matrix.shape) - len(self.pred))]
        return ConfusionMatrix(self.true, tuple(pred[k] for k in order), matrix)

    def square(self) -> ConfusionMatrix:
        size = max(self.matrix.shape)
        out = np.zeros((size, size), self.matrix.dtype)
        out[: len(self.true), : len(self.pred)] = self.matrix
        pad = lambda x: (*x, *[PAD] * (size - len(x)))
        return ConfusionMatrix(pad(self.true), pad(self.pred), out)

    def table(self, spark) -> DataFrame:
        """(row, column, true, pred, n) for a plot."""
        rows = [(i, j, str(t), str(p), int(self.matrix[i, j])) for i, t in enumerate(self.true) for j, p in enumerate(self.pred)]
        return spark.createDataFrame(rows, "row int, column int, true string, pred string, n long")


#: Fixed value: label of padding.
PAD = -2


def confusion_matrix(cells: DataFrame) -> ConfusionMatrix:
    """Of a contingency table; its grid of labels is gathered."""
    rows = cells.collect()
    true, pred = (sorted({r[c] for r in rows}, key=lambda x: (x is None, str(type(x)), x)) for c in ("true", "pred"))
    at_true, at_pred = ({x: k for k, x in enumerate(names)} for names in (true, pred))
    matrix = np.zeros((len(true), len(pred)), np.int64)
    for r in rows:
        matrix[at_true[r["true"]], at_pred[r["pred"]]] = r["n"]
    return ConfusionMatrix(tuple(true), tuple(pred), matrix)


def rearrange(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix with its columns in the order of the best one-to-one match, zeros where columns are missing, and that order."""
    n, m = matrix.shape
    size = max(n, m)
    wide = np.zeros((n, size), matrix.dtype)
    wide[:, :m] = matrix
    matched = best_assignment(wide)
    rest = [k for k in range(size) if k not in set(matched.tolist())]
    rest.sort(key=lambda k: (wide[:, k].max(initial=0), k), reverse=True)
    order = np.array([*matched.tolist(), *rest])
    return wide[:, order], order


#: Label columns up to which pairs are counted from all their subsets.
MOST_COLUMNS = 16


def multi_labeling_pair_counts(df: DataFrame, true: list[str], pred: list[str], remove_noise_spaces: bool = False) -> DataFrame:
    """Pair counts where two points are together if any of the label columns agrees.

    Pairs that agree in any column follow, by inclusion and exclusion, from the
    pairs that agree in all columns of each subset, which are counted from
    group sizes: one aggregation with grouping sets, and no pairs of rows.
    ``remove_noise_spaces``: columns of one label are left out first.
    """
    if remove_noise_spaces:
        several = df.agg(*[F.count_distinct(c).alias(f"c{k}") for k, c in enumerate([*true, *pred])]).first()
        kept = [c for k, c in enumerate([*true, *pred]) if several[k] != 1]
        true, pred = [c for c in true if c in kept], [c for c in pred if c in kept]
    names = [f"l{k}" for k in range(len(true) + len(pred))]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} label columns")
    tuples = df.groupBy(*[F.col(c).alias(n) for c, n in zip([*true, *pred], names)]).agg(F.count("*").alias("n"))
    spark, a, b = df.sparkSession, len(true), len(pred)
    # rows with a null label never agree in that column
    masks = spark.createDataFrame([(sum(1 << k for k in x),) for r in range(a + b + 1) for x in itertools.combinations(range(a + b), r)], "mask long")
    held = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) > 0, F.struct(F.col(n))) for k, n in enumerate(names)]
    whole = F.lit(True)
    for k, n in enumerate(names):
        whole = whole & ((F.col("mask").bitwiseAND(F.lit(1 << k)) == 0) | F.col(n).isNotNull())
    groups = tuples.crossJoin(F.broadcast(masks)).where(whole).groupBy("mask", *[h.alias(f"g{k}") for k, h in enumerate(held)]).agg(F.sum("n").alias("n"))
    sums = groups.groupBy("mask").agg(F.sum(_pairs(F.col("n"))).alias("pairs"))
    low, high = F.col("mask").bitwiseAND(F.lit((1 << a) - 1)), F.shiftright("mask", a)
    sign = lambda part: F.when(F.bit_count(part) % 2 == 1, 1).otherwise(-1)
    some = lambda want, value: F.coalesce(F.sum(F.when(want, value * F.col("pairs"))), F.lit(0).cast("decimal(38,0)"))
    one = sums.agg(
        some((low > 0) & (high > 0), sign(low) * sign(high)).alias("both"),
        some((low > 0) & (high == 0), sign(low)).alias("t"),
        some((low == 0) & (high > 0), sign(high)).alias("p"),
        some(F.col("mask") == 0, F.lit(1)).alias("every"),
    )
    of = lambda value, name: value.cast("long").alias(name)
    return one.select(of(F.col("both"), "tp"), of(F.col("p") - F.col("both"), "fp"), of(F.col("t") - F.col("both"), "fn"), of(F.col("every") - F.col("t") - F.col("p") + F.col("both"), "tn"))


def multi_labeling_pair_scores(df: DataFrame, true: list[str], pred: list[str], remove_noise_spaces: bool = True) -> DataFrame:
    """Jaccard, Rand, precision, recall and F1 of two sets of labelings."""
    return pair_scores(multi_labeling_pair_counts(df, true, pred, remove_noise_spaces))
