"""Best-fit packing by bin completion.

Documents become pieces of at most ``capacity`` tokens.  How many pieces there
are of each length is a table of at most ``capacity`` rows, whatever the size of
the corpus, so the packing is solved once, globally, on that histogram: a
branch-and-bound search takes the longest remaining length, enumerates the
undominated fillings around it, fullest first, and applies a filling as often
as the histogram allows.  Bits of the sums that the remaining lengths reach
lead the enumeration, so that it meets no dead end.  Descents that always take
a best fit are the first incumbents; a branch is left when its waste, or a
lower bound of what the remaining lengths need, cannot beat the incumbent.
Each application uses up a length or nearly so, hence a solution has a few
thousand patterns at most.

Pieces then find their place from (length, rank among equal lengths) alone.
Ranks come from windows over (length, salt) and offsets over the salts, so a
length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import blocks, built, reliable, share, shuffle_partitions, table
from quillon.llm.tokens import Encoder, default_path, prove

CAPACITY = 2048
#: Nodes of the search after the first incumbents, and steps to an undominated filling of like lengths.
NODES, LOOK = 4000, 32


def _room(counts: list[int], x: int, capacity: int) -> int:
    return min(counts[x], capacity // x)


def dominated(filling: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether one spare item can take the place of some items of ``filling`` and leave no more waste.

    ``spare``: bits at the lengths that are left beside the filling.  By Korf
    (2003) a filling is undominated if and only if no subset of it, the empty
    one included, has a sum s with s < t <= s + waste for a spare length t, nor
    two items or more of exactly the sum t.
    """
    sums, several, single = 1, 0, 0
    for x in filling:
        several |= several << x | single << x
        single |= 1 << x
        sums |= sums << x
    if spare & several:
        return True
    if not waste:
        return False
    reach, wide = sums, 1  # the sums and the wide - 1 numbers above each
    while wide < waste:
        step = min(wide, waste - wide)
        reach, wide = reach | reach << step, wide + step
    return bool(spare & reach << 1)


class _Stock:
    """What is left of the histogram, with the sums that it can still fill."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.mask = capacity, (2 << capacity) - 1
        self.counts = [0] * (capacity + 1)
        for x, n in histogram.items():
            self.counts[x] = n
        self.lengths = [x for x in range(1, capacity + 1) if self.counts[x]]
        self.spare = sum(1 << x for x in self.lengths)
        #: reach[k]: bits at the sums of items among the k shortest lengths; right up to self.right
        self.reach, self.right = [1] + [0] * len(self.lengths), 0

    def change(self, x: int, by: int) -> None:
        before, usable = self.counts[x], _room(self.counts, x, self.capacity)
        self.counts[x] = before + by
        k = bisect_left(self.lengths, x)
        if not self.counts[x]:
            del self.lengths[k]
            self.spare ^= 1 << x
        elif not before:
            self.lengths.insert(k, x)
            self.spare ^= 1 << x
        if _room(self.counts, x, self.capacity) != usable:
            self.right = min(self.right, k)

    def apply(self, pattern: tuple[int, ...], times: int) -> None:
        for x, k in Counter(pattern).items():
            self.change(x, -k * times)

    def reached(self, k: int) -> int:
        """reach[k], made up to there where it is not known."""
        if len(self.reach) <= k:
            self.reach.extend([0] * (k + 1 - len(self.reach)))
        for j in range(self.right, k):
            x, sums = self.lengths[j], self.reach[j]
            n, step = _room(self.counts, x, self.capacity), 1
            while n > 0:
                sums |= sums << min(n, step) * x
                n, step = n - step, 2 * step
            self.reach[j + 1] = sums & self.mask
        self.right = max(self.right, k)
        return self.reach[k]

    def exactly(self, total: int, below: int, even: bool):
        """Fillings of exactly ``total`` from the ``below`` shortest lengths, without dead ends.

        Longest items first, or, if ``even``, fewest items of like lengths first.
        """
        if not total:
            yield ()
            return
        below = min(below, bisect_right(self.lengths, total))
        if not self.reach[below] >> total & 1:
            return
        start = bisect_right(self.lengths, total // -(-total // self.lengths[below - 1])) if even else below
        least = bisect_left(range(below + 1), True, key=lambda k: bool(self.reach[k] >> total & 1))  # reached from there on
        for k in [*range(start, least - 1, -1), *range(max(start + 1, least), below + 1)]:
            x, shorter = self.lengths[k - 1], self.reach[k - 1]
            for n in range(min(self.counts[x], total // x), 0, -1):
                if shorter >> total - n * x & 1:
                    for rest in self.exactly(total - n * x, k - 1, even):
                        yield (x,) * n + rest

    def fillings(self, room: int, even: bool, every: bool):
        """Undominated fillings of ``room`` or less (or ``every`` one), by waste, then as in :meth:`exactly`.

        The first is the best fit.  Yields None for each filling that is
        dominated, so that a caller can count its steps.
        """
        below = bisect_right(self.lengths, room)
        sums = self.reached(below) & ((2 << room) - 1)
        while sums:
            total = sums.bit_length() - 1
            for filling in self.exactly(total, below, even):
                used = Counter(filling)
                spare = self.spare
                for x, n in used.items():
                    if n == self.counts[x]:
                        spare ^= 1 << x
                yield None if not every and dominated(filling, room - total, spare) else filling
            sums ^= 1 << total

    def least(self, total: int) -> int:
        """Lower bound of the sequences that the stock needs: by volume, and by the classes of Martello and Toth."""
        sizes = np.array(self.lengths, np.int64)
        if not len(sizes):
            return 0
        n = np.array([self.counts[x] for x in self.lengths], np.int64)
        amount, volume = np.append(0, n.cumsum()), np.append(0, (n * sizes).cumsum())
        half = bisect_right(self.lengths, self.capacity // 2)
        cuts = np.append(0, sizes[:half])  # smallest length that is counted
        at = np.searchsorted(sizes, cuts)
        large = np.maximum(np.searchsorted(sizes, self.capacity - cuts, side="right"), half)
        alone = amount[-1] - amount[half]
        shared = (amount[large] - amount[half]) * self.capacity - (volume[large] - volume[half])
        over = np.maximum(0, volume[half] - volume[np.minimum(at, half)] - shared)
        return max(-(-total // self.capacity), int((alone - (-over // self.capacity)).max()))


def solve(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) and how often each is used; together they use up the histogram.

    Three descents take the best fit at every place, as often as it can be:
    the one of the longest items, that of items of like lengths, and the same
    with dominated fillings.  The best is the incumbent.  Then single places of the incumbent, at distances 1, 2, 4, ... from its
    end, take their next undominated filling instead and go on by best fit
    (limited discrepancy); what improves is the new incumbent.  What is left of
    ``nodes`` goes to a complete depth-first search.  The search ends early
    where the incumbent meets the lower bound; the bound on nodes costs
    sequences at most, never pieces.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    if not counts:
        return []
    total = sum(x * n for x, n in counts.items())
    stock = _Stock(counts, capacity)
    floor = stock.least(total)
    path: list[tuple[tuple[int, ...], int]] = []
    best: list[tuple[tuple[int, ...], int]] = []
    best_bins, bins, waste, seen = 1 << 62, 0, 0, 0

    def step(pattern: tuple[int, ...], times: int) -> None:
        nonlocal bins, waste, seen
        stock.apply(pattern, times)
        path.append((pattern, times))
        bins, waste, seen = bins + times, waste + times * (capacity - sum(pattern)), seen + 1

    def back() -> None:
        nonlocal bins, waste
        pattern, times = path.pop()
        stock.apply(pattern, -times)
        bins, waste = bins - times, waste - times * (capacity - sum(pattern))

    def hopeless() -> bool:
        left = total + waste - bins * capacity
        if waste > (best_bins - 1) * capacity - total:
            return True
        return not len(path) % 16 and bins + stock.least(left) >= best_bins

    def often(pattern: tuple[int, ...]) -> int:
        return min(stock.counts[x] // k for x, k in Counter(pattern).items())

    def options(even: bool, every: bool = False):
        """Patterns around the longest item left, best fit first; None where a step went to a dominated one."""
        longest = stock.lengths[-1]
        room = capacity - longest
        found = stock.fillings(room, even, every)
        while True:
            stock.change(longest, -1)
            stock.reached(bisect_right(stock.lengths, room))
            filling = next(found, False)
            stock.change(longest, 1)
            if filling is False:
                return
            yield filling if filling is None else (longest, *filling)

    def descend() -> None:
        """Best fit from here on; what it ends with is the incumbent if it is better."""
        nonlocal best, best_bins
        while stock.lengths:
            if hopeless():
                return
            pattern = next(filter(None, islice(options(even, every), LOOK)), None) or next(options(False))
            step(pattern, often(pattern))
        if bins < best_bins:
            best, best_bins = list(path), bins

    def alternative(rank: int) -> tuple[int, ...] | None:
        nonlocal seen
        for pattern in options(even):
            seen += pattern is None
            if seen >= nodes:
                return None
            if pattern is not None:
                if not rank:
                    return pattern
                rank -= 1
        return None

    def choices():
        """Each pattern as often as it can be, then those that can be more often once."""
        again = False
        for pattern in options(even):
            yield pattern and (pattern, often(pattern))
            again = again or pattern is not None and often(pattern) > 1
        for pattern in options(even) if again else ():
            if pattern is None or often(pattern) > 1:
                yield pattern and (pattern, 1)

    rule = (False, False)
    for even, every in ((False, False), (True, False), (True, True)):
        before = best
        if best_bins > floor:
            descend()
        if best is not before:
            rule = (even, every)
        while path:
            back()
    even, every = rule
    rank, began = 1, seen
    nodes += began
    while best_bins > floor and seen < (nodes + began) // 2:
        base, some = best, False
        for distance in [1 << k for k in range(len(base).bit_length()) if 1 << k < len(base)] + [len(base)]:
            while path:
                back()
            before = seen
            for pattern, times in base[: len(base) - distance]:
                step(pattern, times)
            seen = before
            other = alternative(rank)
            if other is not None:
                some = True
                step(other, often(other))
                descend()
            if best is not base or seen >= (nodes + began) // 2:
                break
        if best is base and not some:
            break
        rank = rank + 1 if best is base else 1
    while path:
        back()
    stack = [choices()] if best_bins > floor else []
    while stack and seen < nodes and best_bins > floor:
        chosen = next(stack[-1], False)
        if chosen is False:
            stack.pop()
            if path:
                back()
        elif chosen is None:
            seen += 1
        else:
            step(*chosen)
            if not stock.lengths and bins < best_bins:
                best, best_bins = list(path), bins
            if not stock.lengths or hopeless():
                back()
            else:
                stack.append(choices())
    return best


def plan(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, uses, first sequence, offset) of its places, by first rank."""
    taken: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.setdefault(x, []).append((taken[x], times, base, offset))
            taken[x] += times
            offset += x
        base += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every text's ids and one closing ``end_id``.

    Only longer documents are cut, from the end, so that the first piece may be
    the shorter one.  Null texts count as empty, whose one piece holds
    ``end_id``.  ``ids`` are little-endian unsigned 32-bit numbers.
    """
    shared = share(docs.sparkSession, prove(path or default_path()))
    closing = end_id.to_bytes(4, "little")

    def cut(frames):
        own = built(shared, Encoder, True)
        for frame in blocks(frames, "text"):
            out = []
            for key, text in zip(frame["id"], frame["text"]):
                data = own.encode(text) + closing
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    end = start + (n % capacity or capacity) if not start else start + capacity
                    part = data[4 * start : 4 * end]
                    out.append((key, piece, start, end - start, zlib.crc32(part), part) if with_ids else (key, piece, start, end - start, zlib.crc32(part)))
                    start, piece = end, piece + 1
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInPandas(cut, schema).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with lengths from 1 to the capacity.

    Equal lengths are ranked by ``order``; rows equal in all of it share their
    places in any order.  Other columns are kept, whatever their names; a
    sequence_id or offset of the input gives way.  An empty table stays empty.
    """
    # the caller's columns stay in one struct, so that no name can clash
    salts = shuffle_partitions(pieces.sparkSession)
    salt = F.pmod(F.xxhash64(*[F.col("row")[c] for c in order]), F.lit(salts)).cast("int")
    held = reliable(pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row")))
    salted = held.select("row", F.col("row")[length_col].cast("long").alias("length"), salt.alias("salt"))
    counts = reliable(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 1).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(plan(solve(histogram, capacity, nodes)))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy(*[F.col("row")[c] for c in order])
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        found = np.zeros((len(length), 2), np.int64)
        sizes, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            rows = places.value[int(sizes[at[0]])]
            row = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
            found[at, 0] = row[:, 2] + ranks[at] - row[:, 0]
            found[at, 1] = row[:, 3]
        return pd.DataFrame({"sequence_id": found[:, 0], "offset": found[:, 1]})

    placed = ranked.withColumn("place", place("length", F.col("rank") + F.col("before")))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*[F.col("row")[c].alias(c) for c in kept], "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces that carry their ids; a sequence never exceeds the capacity."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    return joined.select("sequence_id", "n_tokens", F.expr("aggregate(parts.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))


def op4_best_fit_packing(spark, sf_dir) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))
