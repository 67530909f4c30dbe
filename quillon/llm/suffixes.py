"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere.
Not every suffix has to be sorted for that.  Of each string of LENGTH bytes the
leftmost smallest hash among its grams of GRAM bytes marks an anchor; equal
strings have their anchor at the same offset, so it is enough to sort the
suffixes that start at anchors, with the bytes before them carried along.  And
only anchors whose gram occurs at two anchors at least can matter; one count of
gram hashes tells which these are (a hash collision only lets one more through).

Map side, the remaining suffixes of a task are sorted and front-coded (length
of the prefix shared with the one before, and the rest) into one run for each
bucket of grams.  Suffixes equal in all their bytes are one entry: that they
repeat is known at once, so their documents are told right there, and a group
of copies costs a run one entry, however large it is.  Reduce side, the runs of
a bucket are combined by a loser tree whose players know the prefix that they
share with the last winner: of two players the one that shares more is the
smaller, and bytes are compared only where both share the same number, from
there on.  The merged order comes with its common prefixes; from these and
from those of the bytes before, sorted likewise, classes of equal strings
follow for each offset of the anchor.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import reliable, shuffle_partitions, table

LENGTH, GRAM = 200, 50
#: Bytes of text whose anchors are sought at once, and of entries in one run.
BLOCK_BYTES, RUN_BYTES = 256 << 10, 48 << 20
BUCKETS_PER_PARTITION = 8

_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of the gram that starts at each position."""
    n = len(data) - gram + 1
    power, width, level = pow(_BASE, 1, 1 << 64), 1, _BYTES[data]
    total, done = None, 0
    while width <= gram:
        if gram & width:
            # the lowest remaining part of the gram starts where the parts before it end
            part = level[done : done + n]
            total = part.copy() if total is None else total * np.uint64(power) + part
            done += width
        if width * 2 <= gram:
            level = level[: len(level) - width] * np.uint64(power) + level[width:]
            power = power * power % (1 << 64)
        width *= 2
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(position, gram hash, smallest and largest offset) of the anchors of joined texts that end at ``ends``.

    The strings whose anchor this is start from position - largest to
    position - smallest.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(data, gram)
    span = length - gram + 1
    best = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    n = len(data) - length + 1
    best = np.minimum(best[:n], best[span - width : span - width + n])
    at = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.arange(n)
    inside = ends[np.searchsorted(ends, starts, side="right")] - starts >= length
    starts, at = starts[inside], at[inside]
    if not len(at):
        return none, none.astype(np.uint64), none, none
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(starts) != 1))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return at[new], h[at[new]], at[new] - starts[last], at[new] - starts[new]


def _pieces(texts: list[bytes], length: int, block: int):
    """Runs of (row, begin, bytes) of about ``block`` bytes; long texts in pieces that overlap by length - 1."""
    held, size = [], 0
    for row, data in enumerate(texts):
        begin = 0
        while True:
            part = data[begin : begin + block + length - 1]
            if len(part) >= length:
                held.append((row, begin, part))
                size += len(part)
            if size >= block:
                yield held
                held, size = [], 0
            begin += block
            if begin + length > len(data):
                break
    if held:
        yield held


def found_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, block: int = BLOCK_BYTES):
    """Blocks of (rows, positions, hashes, smallest, largest offsets)."""
    for held in _pieces(texts, length, block):
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(sizes)
        at, h, low, high = anchors(np.frombuffer(b"".join(p for _, _, p in held), np.uint8), ends, length, gram)
        of = np.searchsorted(ends, at, side="right")
        rows = np.array([r for r, _, _ in held])[of]
        yield rows, at - (ends - sizes)[of] + np.array([b for _, b, _ in held])[of], h, low, high


def common(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix, known to be k at least."""
    n = min(len(a), len(b))
    while k < n:
        x, y = a[k : k + 32], b[k : k + 32]
        if x != y:
            for p, q in zip(x, y):
                if p != q:
                    return k
                k += 1
            return k
        k += 32
    return n


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths and rests of sorted suffixes."""
    shared, rests, last = [], [], b""
    for s in suffixes:
        k = common(last, s, 0)
        shared.append(k)
        rests.append(s[k:])
        last = s
    return shared, rests


class LoserTree:
    """Merges front-coded runs; yields (run, place, suffix, prefix shared with the one before)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.text: list[bytes | None] = [None] * self.size
        self.shared, self.place = [0] * self.size, [0] * self.size
        for r, (_, rests) in enumerate(runs):
            if rests:
                self.text[r] = rests[0]
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        """Whether a comes before b; the loser then knows what it shares with the winner."""
        x, y = self.text[a], self.text[b]
        if y is None or x is None:
            return y is None
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return p > q
        k = common(x, y, p)
        if k == len(x) or k < len(y) and x[k] < y[k]:
            self.shared[b] = k
            return True
        self.shared[a] = k
        return False

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won = self._beats(a, b)
        self.losers[node] = b if won else a
        return a if won else b

    def __iter__(self):
        while (text := self.text[w := self.winner]) is not None:
            yield w, self.place[w], text, self.shared[w]
            self.place[w] += 1
            shared, rests = self.runs[w]
            if self.place[w] < len(rests):
                k = shared[self.place[w]]
                self.text[w], self.shared[w] = text[:k] + rests[self.place[w]], k
            else:
                self.text[w] = None
            node = (w + self.size) // 2
            while node:
                other = self.losers[node]
                if not self._beats(w, other):
                    self.losers[node], w = w, other
                node //= 2
            self.winner = w


def repeated_starts(runs: list[tuple], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(entry, offset) of the strings that occur in two entries; entries count on through the runs.

    A run is (shared, rests, lefts, lows): front-coded suffixes from the anchor,
    the bytes before it, and the smallest offset.
    """
    base = np.cumsum([0, *[len(r[1]) for r in runs]])
    order, shares = [], []
    for run, place, _, shared in LoserTree([(r[0], r[1]) for r in runs]):
        order.append(base[run] + place)
        shares.append(shared)
    n = len(order)
    order, shares = np.array(order, np.int64), np.array(shares, np.int64)
    lefts = [x for r in runs for x in r[2]]
    lows = np.array([x for r in runs for x in r[3]], np.int64)[order]
    backward = [lefts[k][::-1] for k in order.tolist()]
    highs = np.array([len(x) for x in backward], np.int64)
    by_left = np.array(sorted(range(n), key=backward.__getitem__), np.int64)
    left_shares = np.array([0, *[common(backward[a], backward[b], 0) for a, b in zip(by_left.tolist(), by_left[1:].tolist())]][:n], np.int64)
    entries, offsets = [], []
    left_class = np.empty(n, np.int64)
    for o in range(int(lows.min()) if n else 0, int(highs.max()) + 1 if n else 0):
        live = np.flatnonzero((lows <= o) & (o <= highs))
        if len(live) < 2:
            continue
        right_class = np.cumsum(shares < length - o)
        left_class[by_left] = np.cumsum(left_shares < o)
        _, group, count = np.unique(left_class[live] * (n + 1) + right_class[live], return_inverse=True, return_counts=True)
        hit = live[count[group] > 1]
        entries.append(order[hit])
        offsets.append(np.full(len(hit), o, np.int64))
    return (np.concatenate(entries), np.concatenate(offsets)) if entries else (np.empty(0, np.int64), np.empty(0, np.int64))


def spans(owners: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, end) of the maximal runs that strings starting there cover."""
    order = np.lexsort((starts, owners))
    owners, starts = owners[order], starts[order]
    if not len(starts):
        return owners, starts, starts
    new = np.flatnonzero(np.concatenate(([True], (np.diff(owners) != 0) | (np.diff(starts) > length))))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    return owners[new], starts[new], starts[last] + length


def _bytes(values) -> list[bytes]:
    return [x.encode() if isinstance(x, str) else b"" for x in values]


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, begin, end) of repeated strings, from rows (k1, k2, text) with a 128-bit key of the row's content."""
    buckets = BUCKETS_PER_PARTITION * shuffle_partitions(keyed.sparkSession)

    def count(frames):
        for frame in frames:
            for _, _, h, _, _ in found_anchors(_bytes(frame["text"]), length, gram):
                values, n = np.unique(h, return_counts=True)
                yield pd.DataFrame({"h": values.view(np.int64), "n": n})

    def mark(frames):
        for frame in frames:
            k1, k2 = frame["k1"].to_numpy(), frame["k2"].to_numpy()
            for rows, _, h, _, _ in found_anchors(_bytes(frame["text"]), length, gram):
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                new = np.concatenate(([True], (np.diff(rows) != 0) | (h[1:] != h[:-1]))) if len(h) else np.empty(0, bool)
                rows, h = rows[new], h[new]
                known = common_grams.value
                held = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                if not held.all():
                    yield pd.DataFrame({"h": h[~held].view(np.int64), "k1": k1[rows[~held]], "k2": k2[rows[~held]], "hs": pd.Series([None] * int((~held).sum()), dtype=object)})
                if held.any():  # a document's common grams are one row
                    own, first = np.unique(rows[held], return_index=True)
                    lists = [x.tolist() for x in np.split(h[held].view(np.int64), first[1:])]
                    yield pd.DataFrame({"h": 0, "k1": k1[own], "k2": k2[own], "hs": pd.Series(lists, dtype=object)})

    twice = reliable(keyed.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    # a gram with more than this share of all anchors would fill a task of the join; there are 4 a partition at most, so they are broadcast
    total = twice.agg(F.sum("n")).first()[0] or 0
    hot = total // (4 * shuffle_partitions(keyed.sparkSession))
    found = np.array([r[0] for r in twice.where(F.col("n") > hot).select("h").collect()], np.int64)
    common_grams = keyed.sparkSession.sparkContext.broadcast(np.sort(found.view(np.uint64)))
    marks = keyed.mapInPandas(mark, "h long, k1 long, k2 long, hs array<long>")
    rest = marks.where("hs is null").select("h", "k1", "k2").join(twice.where(F.col("n") <= hot).select("h"), "h", "left_semi")
    marked = rest.select("k1", "k2", F.array("h").alias("hs")).unionAll(marks.where("hs is not null").select("k1", "k2", "hs"))
    lists = marked.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"))
    chosen = keyed.join(lists, ["k1", "k2"])

    def sort(frames):
        """Runs for the buckets, and spans of what repeats within the task."""
        entries: dict[tuple, list] = {}
        held = 0
        told: list[tuple] = []

        def flush():
            nonlocal held
            per: dict[int, list] = {}
            for (bucket, right, left, low), posting in entries.items():
                per.setdefault(bucket, []).append((right, left, low, posting))
            for bucket, rows in per.items():
                rows.sort(key=lambda r: r[0])
                shared, rests = front_code([r[0] for r in rows])
                yield bucket, zstandard.compress(pickle.dumps((shared, rests, [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]), 5), 3)
            entries.clear()
            held = 0

        def frame_of(rows):
            return pd.DataFrame({"bucket": [b for b, _ in rows], "run": [r for _, r in rows], "k1": 0, "k2": 0, "begin": 0, "end": 0})

        for frame in frames:
            texts = _bytes(frame["text"])
            k1, k2 = frame["k1"].tolist(), frame["k2"].tolist()
            wanted = [set(x.tolist()) for x in frame["hs"]]
            for rows, at, h, low, high in found_anchors(texts, length, gram):
                for row, p, value, lo, hi in zip(rows.tolist(), at.tolist(), h.view(np.int64).tolist(), low.tolist(), high.tolist()):
                    if value not in wanted[row]:
                        continue
                    data = texts[row]
                    key = (value % buckets, data[p : p + length - lo], data[p - hi : p], lo)
                    posting = (k1[row], k2[row], p)
                    if key not in entries:
                        entries[key] = posting
                        held += length + hi - lo + 100
                        continue
                    if entries[key] is not None:
                        told.append((*entries[key], lo, hi))
                        entries[key] = None
                    told.append((*posting, lo, hi))
                if held > RUN_BYTES:
                    yield frame_of(list(flush()))
            if told:
                t = np.array(told, np.int64)
                told.clear()
                # one run of starts for each anchor; consecutive ones of a document meet
                _, owner = np.unique(t[:, :2], axis=0, return_inverse=True)
                first = np.unique(owner, return_index=True)[1]
                order = np.lexsort((t[:, 2] - t[:, 4], owner))
                begin, stop, own = (t[:, 2] - t[:, 4])[order], (t[:, 2] - t[:, 3])[order] + length, owner[order]
                # ends grow with begins only up to overlaps, so take the running maximum within a document
                shift = own * np.int64(1 << 40)
                top = np.maximum.accumulate(stop + shift) - shift
                new = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (begin[1:] > top[:-1]))))
                last = np.concatenate((new[1:], [len(own)])) - 1
                yield pd.DataFrame({"bucket": np.arange(len(new)) % buckets, "run": None, "k1": t[first[own[new]], 0], "k2": t[first[own[new]], 1], "begin": begin[new], "end": top[last]})
        if entries:
            yield frame_of(list(flush()))

    runs = chosen.select("k1", "k2", "text", "hs").mapInPandas(sort, "bucket int, run binary, k1 long, k2 long, begin long, end long")
    dealt = runs.repartition(F.col("bucket")).sortWithinPartitions("bucket")

    def settle(held: list[bytes]):
        loaded = [pickle.loads(zstandard.decompress(x)) for x in held]
        entry, offset = repeated_starts([x[:4] for x in loaded], length)
        postings = [p for x in loaded for p in x[4]]
        named = np.array([p is not None for p in postings], bool)
        keep = named[entry] if len(entry) else np.empty(0, bool)
        entry, offset = entry[keep], offset[keep]
        if not len(entry):
            return None
        table_ = np.array([p if p is not None else (0, 0, 0) for p in postings], np.int64)
        keys, owner = np.unique(table_[entry][:, :2], axis=0, return_inverse=True)
        own, begin, end = spans(owner.ravel(), table_[entry, 2] - offset, length)
        return pd.DataFrame({"k1": keys[own, 0], "k2": keys[own, 1], "begin": begin, "end": end})

    def merge(frames):
        held: list[bytes] = []
        of = None
        for frame in frames:
            told = frame[frame["run"].isna()]
            if len(told):
                yield told[["k1", "k2", "begin", "end"]]
            for bucket, run in zip(frame["bucket"], frame["run"]):
                if run is None:
                    continue
                if bucket != of:
                    if held and (out := settle(held)) is not None:
                        yield out
                    held, of = [], bucket
                held.append(run)
        if held and (out := settle(held)) is not None:
            yield out

    return dealt.mapInPandas(merge, "k1 long, k2 long, begin long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, removed, kept): spans array<struct<begin,end>> of removed bytes, and the bytes that stay.

    Null texts count as empty and lose nothing.  Matches never cross rows;
    repeated rows repeat each other.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = keyed.select("id", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit("second"), "id").alias("k2"), "text")
    found = repeated_spans(keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text"), length, gram)
    per_doc = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    joined = keyed.join(per_doc, ["k1", "k2"], "left").select("id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(frames):
        for frame in frames:
            out = []
            for key, data, listed in zip(frame["id"], _bytes(frame["text"]), frame["spans"]):
                merged: list[list[int]] = []
                for s in listed if listed is not None else ():
                    a, b = s["begin"], s["end"]
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *[x for m in merged for x in m], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if merged else data
                out.append((key, len(data), [{"begin": a, "end": b} for a, b in merged], kept))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "removed", "kept"])

    return joined.mapInPandas(cut, f"id {kind}, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
