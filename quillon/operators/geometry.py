"""Feature matrices as DataFrames (id, features): distances, neighbours, centroids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.lineage import cut

#: Points in a block, whose distances to another a task holds at once, and in a stripe, of which it holds two; stripes at least.
BLOCK, STRIPE, SIDE = 256, 1 << 15, 8


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """(label, centroid): per-dimension means, put back in order."""
    long = df.select(F.col(label).alias("label"), F.posexplode(features).alias("dim", "x"))
    means = long.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).select("label", F.expr("transform(c, e -> e.x)").alias("centroid"))


def assign(df: DataFrame, centres: DataFrame, id_col: str = "id", features: str = "features") -> DataFrame:
    """(id, cluster, d2): the nearest centre of each point, the first label winning ties.

    The centres, k rows of d numbers, are gathered in one broadcast row and
    searched by a higher-order expression: no join fan-out and no shuffle.
    """
    held = centres.agg(F.array_sort(F.collect_list(F.struct(F.col("label"), F.col("centroid")))).alias("centres"))
    near = F.array_min(F.transform("centres", lambda c: F.struct(squared_distance(F.col(features), c["centroid"]).alias("d2"), c["label"].alias("label"))))
    found = df.crossJoin(F.broadcast(held)).select("*", near.alias("near"))
    return found.select(*[c for c in df.columns], F.col("near.label").alias("cluster"), F.col("near.d2").alias("d2"))


def lloyd_step(df: DataFrame, centres: DataFrame, id_col: str = "id", features: str = "features") -> DataFrame:
    """Centres after one round; a centre without points is gone."""
    return centroids(assign(df, centres, id_col, features), "cluster", features)


@dataclass(frozen=True)
class Tiles:
    """Rows (tile, side, id, f, ..) sorted by tile and side; ``half``: each unordered pair of points once."""

    rows: DataFrame
    half: bool


#: Sides of a tile: rows of its first stripe, of its second, and of both where they are the same.
FIRST, SECOND, BOTH = 0, 1, 2


def tiles(df: DataFrame, id_col: str = "id", features: str = "features", extra: tuple[str, ...] = (), half: bool = False, stripe: int | None = None) -> Tiles:
    """The points dealt to a grid whose rows and columns are stripes of about STRIPE points, with the ``extra`` columns.

    A tile gets the points of two stripes and makes their pairs itself, so a
    point travels twice for each stripe and not for each block that it meets.
    A task holds two stripes however many points there are.  Features of single
    precision travel as they are; tasks reckon in doubles.
    """
    n, stripe = df.count(), stripe or STRIPE
    single = df.schema[features].dataType.simpleString() == "array<float>"
    side = max(1, -(-n // stripe), min(SIDE, -(-n // BLOCK)))
    rows = df.select(F.pmod(F.xxhash64(id_col), F.lit(side)).cast("int").alias("own"), F.col(id_col).alias("id"), F.col(features).cast("array<float>" if single else "array<double>").alias("f"), *[F.col(c).alias(c) for c in extra])
    numbers, own = F.sequence(F.lit(0), F.lit(side - 1)), F.col("own")
    place = lambda row, column, at: F.struct((row * side + column).alias("tile"), F.lit(at).alias("side"))
    as_first = F.transform(F.filter(numbers, lambda x: (x > own) if half else (x != own)), lambda x: place(own, x, FIRST))
    as_second = F.transform(F.filter(numbers, lambda x: (x < own) if half else (x != own)), lambda x: place(x, own, SECOND))
    dealt = rows.select(F.explode(F.concat(as_first, as_second, F.array(place(own, own, BOTH)))).alias("at"), "*").select("at.tile", "at.side", "id", "f", *extra)
    return Tiles(dealt.repartition(side * (side + 1) // 2 if half else side * side, "tile").sortWithinPartitions("tile", "side"), half)


def _arrays(frames: list[pd.DataFrame], names: list[str]) -> dict[str, np.ndarray]:
    held = pd.concat(frames, ignore_index=True) if frames else None
    return {c: held[c].to_numpy() for c in names} if held is not None else {}


def per_tile_of_stripes(tiled: Tiles, work, schema: str) -> DataFrame:
    """The frames of ``work(a, b)`` for each tile: dicts of arrays of both stripes; b is None where a stripe meets itself."""
    names = [c for c in tiled.rows.columns if c not in ("tile", "side", "f")]

    def run(frames):
        tile, held = None, {}

        def done():
            held_of = {k: _arrays([p for p, _ in v], names) | {"f": np.concatenate([f for _, f in v]).astype(float, copy=False)} for k, v in held.items()}
            if BOTH in held_of:
                yield from work(held_of[BOTH], None)
            elif len(held_of) == 2:
                yield from work(held_of[FIRST], held_of[SECOND])

        for frame in frames:
            for (at, side), part in frame.groupby(["tile", "side"]):
                if at != tile:
                    yield from done()
                    tile, held = at, {}
                held.setdefault(side, []).append((part[names], np.stack(part["f"])))
        yield from done()

    return tiled.rows.mapInPandas(run, schema)


def _blocks(x: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
    return [{k: v[at : at + BLOCK] for k, v in x.items()} for at in range(0, len(x["f"]), BLOCK)]


def row_distances(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of a row, or of each row, to the rows of b; of two points always the same number."""
    diff = b - x
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def paired_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Plain distances of the rows i of a to the rows j of b, one by one."""
    return np.concatenate([row_distances(a[i[t : t + (1 << 15)]], b[j[t : t + (1 << 15)]]) for t in range(0, len(i), 1 << 15)]) if len(i) else np.zeros(0)


def _block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([row_distances(row, b) for row in a])


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and for each row of a by how much they may be off."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    # the squared lengths are two more columns of the product
    d2 = np.column_stack([a, na, np.ones(len(a))]) @ np.column_stack([-2 * b, np.ones(len(b)), nb]).T
    return d2, 8 * (a.shape[1] + 8) * np.finfo(float).eps * (na + nb.max(initial=0.0))


def _sharpened(d: np.ndarray, a: np.ndarray, b: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``d`` with the marked cells set to the plain distances."""
    i, j = np.nonzero(which) if which.any() else ((), ())
    for at in range(0, len(i), 1 << 15):
        r, c = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        d[r, c] = row_distances(a[r], b[c])
    return d


def quick_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of :func:`quick_distances`."""
    d2, off = _products(a, b)
    near = d2 <= 1e6 * off[:, None]
    if near.any():
        i, j = np.nonzero(near)
        for at in range(0, len(i), 1 << 15):
            r, c = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            d2[r, c] = row_distances(a[r], b[c]) ** 2
    return d2


def quick_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by a matrix product, to ten digits or so; where that loses digits, plain ones.  For sums, not for ties."""
    d2, off = _products(a, b)
    near = d2 <= 1e6 * off[:, None]
    return _sharpened(np.sqrt(np.maximum(d2, 0, out=d2), out=d2), a, b, near)


def within(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances, plain ones where they are no larger than the radius or near it, and which are no larger."""
    d2, off = _products(a, b)
    near = d2 <= radius * radius + off[:, None]
    d = _sharpened(np.full(d2.shape, np.inf), a, b, near)
    return d, d <= radius


def block_pairs(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None):
    """Slices of a and of b, whose blocks make each pair of two stripes once, or of one stripe (b None), and if both are the same block."""
    other = a if b is None else b
    for s in range(0, len(a["f"]), BLOCK):
        for t in range(s if b is None else 0, len(other["f"]), BLOCK):
            yield slice(s, s + BLOCK), slice(t, t + BLOCK), b is None and s == t


def per_tile(tiled: Tiles, work, schema: str, distances=_block_distances, fold=None) -> DataFrame:
    """``work(a, b, d, same)`` of every pair of blocks: dicts of arrays of both and their distances; gives a frame.

    ``fold``: makes one frame of those of a block against all others of its tile.
    """
    half = tiled.half

    def run(a, b):
        first = _blocks(a)
        second = first if b is None else _blocks(b)
        for i, x in enumerate(first):
            found = (work(x, y, distances(x["f"], y["f"]) if distances else None, b is None and i == j) for j, y in enumerate(second) if b is not None or not half or i <= j)
            if fold:
                yield fold(pd.concat(list(found), ignore_index=True))
            else:
                yield from found

    return per_tile_of_stripes(tiled, run, schema)


def pair_distances(df: DataFrame, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, j, d) over all ordered pairs of different points; n (n - 1) rows by its meaning."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(a, b, d, same):
        i, j = np.repeat(a["id"], len(b["id"])), np.tile(b["id"], len(a["id"]))
        other = i != j
        return pd.DataFrame({"i": i[other], "j": j[other], "d": d.ravel()[other]})

    return per_tile(tiles(df, id_col, features), work, f"i {kind}, j {kind}, d double")


def _best(row: np.ndarray, d: np.ndarray, j: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, k) smallest distances of each row and where they lead, by (d, j); infinite and -1 where there are fewer."""
    order = np.lexsort((j, d, row))
    row, d, j = row[order], d[order], j[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    best, at = np.full((rows, k), np.inf), np.full((rows, k), -1)
    best[row[kept], rank[kept]], at[row[kept], rank[kept]] = d[kept], j[kept]
    return best, at


def _merged(best: np.ndarray, at: np.ndarray, row: np.ndarray, d: np.ndarray, j: np.ndarray) -> None:
    """Puts distances d of rows to codes j among the best of the rows so far."""
    rows, own = np.unique(row, return_inverse=True)
    held = at[rows] >= 0
    ways = np.concatenate([np.repeat(np.arange(len(rows)), held.sum(1)), own]), np.concatenate([best[rows][held], d]), np.concatenate([at[rows][held], j])
    best[rows], at[rows] = _best(*ways, len(rows), best.shape[1])


def _candidates(d2: np.ndarray, off: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which squared distances, off by ``off`` at most, may be among the nearest of their rows."""
    limit, k = best[:, -1] ** 2, best.shape[1]
    if np.isinf(limit).any() and d2.shape[1] > k:
        limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1] + off)
    return d2 <= np.minimum(limit + off, np.finfo(float).max)[:, None]


def _nearest_of_stripes(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, k: int):
    """(ids, codes into them, distances) of the k nearest of the other stripe to each row of both, or within one (b None), ties by id.

    Each pair's matrix product serves both its points; plain distances are taken of what may be among the nearest.
    """
    ids, codes = np.unique(a["id"] if b is None else np.concatenate([a["id"], b["id"]]), return_inverse=True)
    first, other = codes[: len(a["id"])], a if b is None else b
    second = first if b is None else codes[len(first) :]
    found = [(np.full((len(c), k), np.inf), np.full((len(c), k), -1)) for c in ((first,) if b is None else (first, second))]
    for s in range(0, len(first), BLOCK):
        x, own = a["f"][s : s + BLOCK], first[s : s + BLOCK]
        for t in range(s if b is None else 0, len(second), 4 * BLOCK):
            y, code = other["f"][t : t + 4 * BLOCK], second[t : t + 4 * BLOCK]
            d2, off = _products(x, y)
            off = np.full(max(d2.shape), off.max(initial=0.0))
            if b is None:
                d2[own[:, None] == code[None, :]] = np.inf
            best, at = found[0]
            which = _candidates(d2, off[: len(x)], best[s : s + BLOCK])
            back, at_back = found[-1]
            later = slice(min(t + (BLOCK if b is None and t == s else 0), len(second)), t + 4 * BLOCK)  # rows that are not looked at as x here
            skip = later.start - t
            which_back = _candidates(d2[:, skip:].T, off[: len(y) - skip], back[later]) if len(y) > skip else np.zeros((0, len(x)), bool)
            i, j = np.nonzero(which)
            j_back, i_back = np.nonzero(which_back)
            j_back = j_back + skip
            if len(i):
                _merged(best, at, i + s, paired_distances(x, y, i, j), code[j])
            if len(i_back):
                _merged(back, at_back, j_back + t, paired_distances(x, y, i_back, j_back), own[i_back])
    for part, (d, at) in zip((a, b), found):
        held = at >= 0
        yield np.repeat(part["id"], held.sum(1)), ids[at[held]], d[held]


def nearest_before(x: np.ndarray, y: np.ndarray, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the nearest of the first ``before`` rows of y for each row of x, ties by id; infinite and -1 where there is none.

    ``before`` must not fall.  Matrix products, then plain distances of what may be the nearest.
    """
    best, at = np.full(len(x), np.inf), np.full(len(x), -1)
    for s in range(0, len(x), BLOCK):
        a, count, d_best, d_at = x[s : s + BLOCK], before[s : s + BLOCK], best[s : s + BLOCK], at[s : s + BLOCK]
        for c in range(0, int(count[-1]), 4 * BLOCK):
            b = y[c : min(c + 4 * BLOCK, int(count[-1]))]
            d2, off = _products(a, b)
            if count[0] < c + len(b):
                d2[np.arange(c, c + len(b)) >= count[:, None]] = np.inf
            limit = np.minimum(np.minimum(d_best**2, d2.min(axis=1) + off) + off, np.finfo(float).max)
            i, j = np.nonzero(d2 <= limit[:, None])
            if not len(i):
                continue
            d = paired_distances(a, b, i, j)
            order = np.lexsort((ids[c + j], d, i))
            i, j, d = i[order], c + j[order], d[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            i, j, d = i[first], j[first], d[first]
            better = (d < d_best[i]) | (d == d_best[i]) & (ids[j] < ids[d_at[i]])
            d_best[i[better]], d_at[i[better]] = d[better], j[better]
    return best, at


def nearest(df: DataFrame, k: int, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, j, d, rank) of the k nearest other points, ties by id.

    Each tile keeps k rows a point, so what is shuffled grows with n * k for
    each stripe and not with the pairs.  The result is a checkpoint, since
    graphs read it several times.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(a, b):
        for i, j, d in _nearest_of_stripes(a, b, k):
            yield pd.DataFrame({"i": i, "j": j, "d": d})

    return cut(neighbours(per_tile_of_stripes(tiles(df, id_col, features, half=True), work, f"i {kind}, j {kind}, d double"), k))


def neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """(i, j, d, rank) of the k nearest, ties by id."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def core_distances(df: DataFrame, min_points: int, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, core): distance to the min_points-th nearest point, the point itself counted."""
    if min_points == 1:
        return df.select(F.col(id_col).alias("i"), F.lit(0.0).alias("core"))
    near = nearest(df, min_points - 1, id_col, features)
    return near.groupBy("i").agg(F.max("d").alias("core"), F.count("*").alias("n")).where(F.col("n") == min_points - 1).select("i", "core")


def label_pair_sums(df: DataFrame, id_col: str = "id", features: str = "features", label: str = "label") -> DataFrame:
    """(label, pairs, total, longest) over the pairs within each label; added up within the tiles."""
    kind = df.schema[label].dataType.simpleString()
    work_schema = f"label {kind}, pairs long, total double, longest double"

    def work(a, b):
        values = np.unique(a[label]) if b is None else np.intersect1d(a[label], b[label])
        for value in values:
            x = a["f"][a[label] == value]
            y = x if b is None else b["f"][b[label] == value]
            pairs, total, longest = 0, 0.0, 0.0
            for s in range(0, len(x), BLOCK):
                for t in range(s if b is None else 0, len(y), BLOCK):
                    part = quick_distances(x[s : s + BLOCK], y[t : t + BLOCK])
                    if b is None and s == t:
                        part = part[np.triu_indices(len(part), 1)]
                    if part.size:
                        pairs, total, longest = pairs + part.size, total + float(part.sum()), max(longest, float(part.max()))
            if pairs:
                yield pd.DataFrame([(value, pairs, total, longest)], columns=["label", "pairs", "total", "longest"])

    sums = per_tile_of_stripes(tiles(df, id_col, features, (label,), half=True), work, work_schema)
    return sums.groupBy("label").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.max("longest").alias("longest"))


def mean_distance(df: DataFrame, id_col: str = "id", features: str = "features") -> float:
    """Mean over all pairs of different points."""
    row = label_pair_sums(df.withColumn("label", F.lit(0)), id_col, features).first()
    return float(row["total"] / row["pairs"]) if row else 0.0


def degrees(df: DataFrame, radius: float, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, degree): other points within the radius; counted within the tiles."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(a, b, d, same):
        d2, off = _products(a["f"], b["f"])
        inside = d2 <= radius * radius - off[:, None]
        unsure = ~inside & (d2 <= radius * radius + off[:, None])
        inside |= _sharpened(np.full(d2.shape, np.inf), a["f"], b["f"], unsure) <= radius if unsure.any() else False
        return pd.DataFrame({"i": a["id"], "degree": inside.sum(axis=1) - (1 if same else 0)})

    fold = lambda found: found.groupby("i", as_index=False).sum()
    return per_tile(tiles(df, id_col, features), work, f"i {kind}, degree long", None, fold).groupBy("i").agg(F.sum("degree").alias("degree"))


def reachability(df: DataFrame, min_points: int, id_col: str = "id", features: str = "features") -> DataFrame:
    """(i, j, reach) for i < j: the distance, at least both core distances."""
    kind = df.schema[id_col].dataType.simpleString()
    core = core_distances(df, min_points, id_col, features)
    rows = df.select(F.col(id_col).alias("i"), F.col(features).alias("features")).join(core, "i")

    def work(a, b, d, same):
        d = np.maximum(d, np.maximum(a["core"][:, None], b["core"][None, :]))
        i, j = np.repeat(a["id"], len(b["id"])), np.tile(b["id"], len(a["id"]))
        first = i < j if same else i != j
        return pd.DataFrame({"i": np.minimum(i, j)[first], "j": np.maximum(i, j)[first], "reach": d.ravel()[first]})

    return per_tile(tiles(rows, "i", "features", ("core",), half=True), work, f"i {kind}, j {kind}, reach double")


def cvnn(df: DataFrame, k: int, id_col: str = "id", features: str = "features", label: str = "label") -> DataFrame:
    """Clustering validation by nearest neighbours of one labeling: (separation, compactness)."""
    li, lj = df.select(F.col(id_col).alias("i"), F.col(label).alias("li")), df.select(F.col(id_col).alias("j"), F.col(label).alias("lj"))
    foreign = nearest(df, k, id_col, features).join(li, "i").join(lj, "j").groupBy("li").agg(F.avg(F.when(F.col("li") != F.col("lj"), 1.0).otherwise(0.0)).alias("s")).agg(F.max("s").alias("separation"))
    inside = label_pair_sums(df, id_col, features, label).agg(F.coalesce(F.sum(F.col("total") / F.col("pairs")), F.lit(0.0)).alias("compactness"))
    return foreign.crossJoin(inside).select(F.round("separation", 6).alias("separation"), F.round("compactness", 6).alias("compactness"))


def cvnn_scores(df: DataFrame, labels: list[str], k: int, id_col: str = "id", features: str = "features") -> list[float]:
    """CVNN of several labelings (columns of df): both terms over their largest, added; a largest of 0 gives 0 for its term."""
    found = np.array([[float(x) for x in cvnn(df, k, id_col, features, c).first()] for c in labels])
    most = found.max(axis=0)
    return (found / np.where(most > 0, most, 1)).sum(axis=1).tolist()
