"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes of doubling
size.  For a class with up to L shingles, documents are cut into windows of 2L
shingles that start every L, so that an item of the class lies whole in one
window and the Jaccard similarity of a containing window is bounded from below
(at containment 0.8, by 0.19).  Windows and items are compared by one-permutation
MinHash with BINS bins: a window is a candidate for an item if the minimum of
any bin agrees.  Of a document only hashes that are some item's bin minimum can
agree, so sketches are made only of the windows around those.  Items of up to
TINY shingles are held against windows of one shingle, whose sketch is its hash
(in wider ones another shingle might push it out of its bin).  Candidates are
verified by the exact containment of their shingles of words in the document.

Documents are searched where they lie: no shuffle.  The items, a stated query
set, go to the tasks in blocks whose size is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blocks, built, share, table

WORDS, CONTAINMENT, BINS, TINY = 5, 0.8, 64, 8
#: Characters of item texts that one search holds; more items make more passes.
BLOCK_OF_ITEMS = 32 << 20
CACHED_WORDS = 500_000

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = _hashes.get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh3_64_intdigest(w.encode())
        out[k] = h
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def sketch(h: np.ndarray) -> np.ndarray:
    """Minimum of each bin; bins go by the top bits of another mix of the hash."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bin_of(h), h)
    return out


def bin_of(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 6)).astype(np.int64)


@dataclass
class Item:
    key: object
    words: list[str]
    width: int
    shingles: set
    size_class: int


class Index:
    """Sketch values of a block of items, by shingle width."""

    def __init__(self, rows: list[tuple]):
        self.items: list[Item] = []
        values: dict[int, dict[int, list[int]]] = {}
        for key, text in rows:
            words = words_of(text) if isinstance(text, str) else []
            if not words:
                continue
            width = min(WORDS, len(words))
            shingles = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
            h = np.unique(shingle_hashes(word_hashes(words), width))
            item = Item(key, words, width, shingles, max(TINY, 1 << (len(shingles) - 1).bit_length()))
            for v in sketch(h)[np.unique(bin_of(h))].tolist():
                values.setdefault(width, {}).setdefault(v, []).append(len(self.items))
            self.items.append(item)
        self.values = {w: (np.array(sorted(v), np.uint64), v) for w, v in values.items()}

    def search(self, text: str) -> list[tuple[Item, int]]:
        """Items contained in a text, with the number of their shingles found."""
        words = words_of(text)
        if not words or not self.values:
            return []
        own = word_hashes(words)
        found = []
        for width, (sorted_values, owners) in self.values.items():
            h = shingle_hashes(own, width)
            if not len(h):
                continue
            at = np.searchsorted(sorted_values, h)
            at[at == len(sorted_values)] = 0
            hits = np.flatnonzero(sorted_values[at] == h)
            if not len(hits):
                continue
            candidates: set[int] = set()
            windows: dict[tuple[int, int], np.ndarray] = {}
            for p, v in zip(hits.tolist(), h[hits].tolist()):
                slot = int(bin_of(np.array([v], np.uint64))[0])
                for k in owners[v]:
                    if k in candidates:
                        continue
                    size = self.items[k].size_class
                    if size <= TINY:
                        candidates.add(k)
                        continue
                    for j in (p // size, p // size - 1):
                        if j < 0:
                            continue
                        if (size, j) not in windows:
                            windows[size, j] = sketch(h[j * size : (j + 2) * size])
                        if int(windows[size, j][slot]) == v:
                            candidates.add(k)
                            break
            if candidates:
                there: dict[int, list[int]] = {}
                asked = np.unique(np.concatenate([shingle_hashes(word_hashes(self.items[k].words), width) for k in candidates]))
                for p in np.flatnonzero(np.isin(h, asked)).tolist():
                    there.setdefault(int(h[p]), []).append(p)
                present = {tuple(words[p : p + width]) for places in there.values() for p in places}
                for k in sorted(candidates):
                    n = len(self.items[k].shingles & present)
                    if n >= CONTAINMENT * len(self.items[k].shingles):
                        found.append((self.items[k], n))
        return found


def indexes(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcast indexes over blocks of the items; a block holds a bounded number of characters."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (BLOCK_OF_ITEMS // 2)))
    out = []
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = [(r["id"], r["text"]) for r in block.collect()]
        out.append(share(benchmark.sparkSession, rows))
    return out


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item id, n_shingles, n_found, containment) for items of which a document holds 0.8 or more.

    Shingles are of five lower-cased words; an item of fewer words is one
    shingle of all its words.  Null and empty items and documents match
    nothing.  Repeated document or item rows give a row each.  Other columns
    are not read.
    """
    of_doc, of_item = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    out = None
    for shared in indexes(benchmark, item_id, item_text):

        def run(frames, shared=shared):
            index = built(shared, Index)
            for frame in blocks(frames, "text"):
                found = [(key, item.key, len(item.shingles), n, n / len(item.shingles)) for key, text in zip(frame["id"], frame["text"]) for item, n in index.search(text)]
                if found:
                    yield pd.DataFrame(found, columns=["id", "item", "n_shingles", "n_found", "containment"])

        part = rows.mapInPandas(run, f"id {of_doc}, item {of_item}, n_shingles long, n_found long, containment double")
        out = part if out is None else out.unionAll(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item."""

    def clean_of(shared):
        @F.pandas_udf("boolean")
        def clean(text: pd.Series) -> pd.Series:
            index = built(shared, Index)
            return pd.Series([not (isinstance(x, str) and index.search(x)) for x in text], dtype=bool)

        return clean

    for shared in indexes(benchmark, item_id, item_text):
        docs = docs.where(clean_of(shared)(F.col(text_col)))
    return docs


def op3_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
