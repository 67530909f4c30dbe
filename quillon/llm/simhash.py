"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of four segments of 16 bits.  Two
fingerprints at distance t <= 3 have, by the strong pigeonring principle, a
segment i from which on every chain of l consecutive segments differs in at
most floor(l * t / 4) bits: none in the first, one in two, two in three.  The
first two steps are the join key: an index row for (i, segment i, segment i+1)
meets probe rows with the same segment i and a segment i+1 that is equal or
has one of its zero bits set.  (Of two segments one bit apart exactly one has
that zero, so each pair is found from one side.)  Pairs must then pass the
third step of the chain, and last the full Hamming distance.

Only distinct fingerprints are joined, so a group of equal texts is one row.
A task scans the rows of a key with numpy; from a key with many rows it emits a
spanning forest in place of all pairs, which leaves the components unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blocks, first_rows, reliable, table, whole_keys
from quillon.llm.graph import components

#: Rows of one key above which a forest is emitted and blocks are compared.
FOREST, SIDE = 48, 1024


def simhash_bytes(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[k : k + (1 << 14)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, hash, fp): hash and signed 64-bit fingerprint of each row's text; null texts count as empty, whose fingerprint is 0."""

    def run(frames):
        for frame in blocks(frames, "text"):
            fp = np.array([simhash_bytes(x.encode(), width) for x in frame["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": frame["id"], "hash": frame["hash"], "fp": fp})

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInPandas(run, f"id {kind}, hash long, fp long")


def _near(x: np.ndarray, y: np.ndarray, first: np.ndarray, distance: int) -> np.ndarray:
    """The third chain step and the full distance, for pairs whose chain starts at segment ``first``."""
    diff = x ^ y
    third = (diff >> (((first + 2) % 4) * 16).astype(np.uint64)) & np.uint64(0xFFFF)
    second = (diff >> (((first + 1) % 4) * 16).astype(np.uint64)) & np.uint64(0xFFFF)
    chain = np.bitwise_count(second).astype(np.int64) + np.bitwise_count(third)
    return (chain <= 3 * distance // 4) & (np.bitwise_count(diff) <= distance)


def _forest(seg: int, index: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over near pairs of (index, probe), compared in blocks."""
    nodes = np.unique(np.concatenate([index, probe]))
    parent = list(range(len(nodes)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    found = []
    at_i, at_p = np.searchsorted(nodes, index), np.searchsorted(nodes, probe)
    for a in range(0, len(index), SIDE):
        for b in range(0, len(probe), SIDE):
            x, y = index[a : a + SIDE, None], probe[None, b : b + SIDE]
            for i, j in np.argwhere(_near(x, y, np.full((1, 1), seg), distance)).tolist():
                u, v = root(int(at_i[a + i])), root(int(at_p[b + j]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    found.append((int(index[a + i]), int(probe[b + j])))
    return found


def _scan(keys: np.ndarray, seg: np.ndarray, fp: np.ndarray, probing: np.ndarray, distance: int) -> np.ndarray:
    """Links within the runs of equal keys of one sorted block."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    # index rows sort before probe rows within a key
    held = np.add.reduceat((~probing).astype(np.int64), starts)
    sizes = ends - starts
    live = (held > 0) & (sizes > 1)
    out = []
    small = live & (sizes <= FOREST)
    for width in np.unique(sizes[small]):
        at = starts[small & (sizes == width)]
        rows = at[:, None] + np.arange(width)
        i, j = np.triu_indices(width, 1)
        a, b = rows[:, i].ravel(), rows[:, j].ravel()
        keep = ~probing[a]  # the first of a pair is an index row
        a, b = a[keep], b[keep]
        keep = _near(fp[a], fp[b], seg[a], distance)
        out.append(np.stack([fp[a[keep]], fp[b[keep]]], axis=1))
    for k in np.flatnonzero(live & (sizes > FOREST)):
        a, b = starts[k], ends[k]
        mine = fp[a:b][~probing[a:b]]
        if links := _forest(int(seg[a]), mine, fp[a:b], distance):
            out.append(np.array(links, dtype=np.uint64).reshape(-1, 2))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def near_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``distance`` <= 3 bits of each other.

    ``distinct``: a column fp of distinct signed 64-bit fingerprints.
    """
    if not 0 <= distance <= 3:
        raise ValueError("a ring of four segments serves distances up to 3")
    piece = lambda k: F.shiftrightunsigned("fp", k * 16).bitwiseAND(F.lit(0xFFFF))
    rings = []
    for k in range(4):
        second = piece((k + 1) % 4)
        key = lambda s, k=k: F.shiftleft(piece(k), 16).bitwiseOR(s).bitwiseOR(F.lit(k << 32))
        rings.append(F.struct(key(second).alias("key"), F.lit(False).alias("probing")))
        for bit in range(16):
            rings.append(F.when(second.bitwiseAND(F.lit(1 << bit)) == 0, F.struct(key(second.bitwiseOR(F.lit(1 << bit))).alias("key"), F.lit(True).alias("probing"))))
    rows = distinct.select("fp", F.explode(F.filter(F.array(*rings), lambda x: x.isNotNull())).alias("r")).select("r.key", "r.probing", "fp")
    dealt = rows.repartition("key").sortWithinPartitions("key", "probing")

    def scan(frames):
        for frame in whole_keys(frames, "key"):
            yield links_of(frame)

    def links_of(now):
        keys = now["key"].to_numpy()
        found = _scan(keys, keys >> 32, now["fp"].to_numpy().view(np.uint64), now["probing"].to_numpy(), distance).view(np.int64)
        found = np.unique(np.sort(found, axis=1), axis=0)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return dealt.mapInPandas(scan, "u long, v long").where("u <> v")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> DataFrame:
    """(id, hash, fp, first): ``first`` is the struct (unnamed, id, hash) of the first row of the component."""
    own = reliable(fingerprints(docs, id_col, text_col, width))
    least = own.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash")).alias("least"))
    found = components(near_links(least.select("fp"), distance))
    joined = least.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "least")
    reach = joined.groupBy("component").agg(F.min("least").alias("reach"))
    better = joined.join(reach, "component").select("fp", "reach")
    # checkpointed, so that both sides are dealt anew and the rows of a large group of copies can be split among tasks
    merged = reliable(least.join(better, "fp", "left").select("fp", F.coalesce("reach", "least").alias("first")))
    return own.join(merged, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Returns (id, fingerprint, component_id): 16 hex digits, and the smallest id
    reachable over links of at most ``distance`` bits.  Null texts count as
    empty; all texts without words share fingerprint zero.  Repeated rows stay
    separate rows of one component; a null id is the smallest of none (a
    component of null ids only has a null component_id).  Other columns of
    ``docs`` are not read; an empty table gives an empty result.
    """
    rows = _grouped(docs, id_col, text_col, width, distance)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """The documents, all columns, with one row of each near-duplicate group: that of the smallest id.

    Of several rows with that id the one of the smallest text hash stays, and
    of rows equal in both any one.  Null ids come after all others.
    """
    own = _grouped(docs, id_col, text_col, width, distance)
    return first_rows(docs, own.select("id", "hash"), own.select("first.id", "first.hash").distinct(), id_col, text_col)


def op10_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
