"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every document.  Only the
table of vote patterns with their counts is gathered (at most 3 to the number
of heuristics, whatever the corpus); expectation-maximisation on it estimates
how often each heuristic is right, and a posterior for each pattern.  A sample
of documents, whose size is a parameter, with these posteriors as soft labels
then trains a logistic regression on hashed n-grams of the text's character
classes, which scores every document.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blocks, table

SLOTS = 1 << 12
ORDERS = (1, 2, 3)
#: Documents the scorer is fitted on, about; drawn by a hash of id and text.
SAMPLE = 4000
EM_ROUNDS, STEPS, RATE, DECAY = 100, 400, 20.0, 1e-5
THRESHOLD = 0.4
#: Largest share of bad votes that a heuristic is taken to cast on good documents.
RARE = 0.002

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_PLAIN = _LOWER + _UPPER + _DIGIT + _SPACE + bytes(range(128, 256)) + b".,;:!?'\"()-"
#: Classes of bytes: lower or non-ASCII, upper, digit, white space, or the byte itself.
_SHAPE = bytes(97 if b in _LOWER or b >= 128 else 65 if b in _UPPER else 48 if b in _DIGIT else 32 if b in _SPACE else b for b in range(256))


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def votes(text: str) -> tuple[int, ...]:
    """Votes of the heuristics: 1 good, -1 bad, 0 abstain; all abstain on a text without words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * 8
    solid = sum(map(len, words))
    upper = len(data) - len(data.translate(None, _UPPER))
    lower = len(data) - len(data.translate(None, _LOWER))
    wide = len(data) - len(data.translate(None, bytes(range(128, 256))))
    odd = len(data.translate(None, _PLAIN)) / solid
    letters = upper + lower + wide
    shout = data.count(b"!") / n
    share = upper / max(1, upper + lower)
    mean = solid / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    again = sum(map(eq, words, words[1:])) / n
    bars = sum(map(data.count, (b" | ", b"\t|", b" || "))) / n
    ends = sum(map(data.count, (b".", b"?"))) / n
    return (
        _vote(odd > 0.08, odd < 0.02),
        _vote(upper + lower >= 20 and share > 0.5, share < 0.3),
        _vote(shout > 0.2, shout < 0.03),
        _vote(mean > 20, 2.5 <= mean <= 12),
        _vote(letters / solid < 0.4, letters / solid > 0.8),
        _vote(len(lines) >= 5 and repeated > 0.5, repeated < 0.1),
        _vote(n >= 10 and again > 0.2, again < 0.05),
        _vote(bars > 0.1, bars == 0 and (n < 10 or ends > 0.01)),
    )


class WeakLabels:
    """Two-class model of independent voters, fitted by EM on counted vote patterns.

    Of each heuristic two accuracies are estimated among its votes: how often it
    votes bad on bad documents, and good on good ones.  The latter is at least
    ``1 - RARE``, as the heuristics are set to leave ordinary text alone; without
    that bound a kind of junk that one heuristic alone sees would end up as a
    kind of good text.  Abstaining says nothing of the class.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS):
        """``patterns``: one row of votes each."""
        bad_votes, good_votes = (patterns == -1).astype(float), (patterns == 1).astype(float)
        good = np.where((patterns == -1).any(axis=1), 0.1, 0.9)
        self.prior, self.on_bad, self.on_good = 0.9, np.empty(0), np.empty(0)
        for _ in range(rounds if len(counts) else 0):
            w0, w1 = counts * (1 - good), counts * good
            self.prior = (w1.sum() + 1) / (counts.sum() + 2)
            self.on_bad = (w0 @ bad_votes + 1) / (w0 @ (bad_votes + good_votes) + 4)
            self.on_good = np.maximum((w1 @ good_votes + 1) / (w1 @ (bad_votes + good_votes) + 1), 1 - RARE)
            self.on_good = np.minimum(self.on_good, 1 - 1e-6)
            odds = np.log(self.prior / (1 - self.prior)) + bad_votes @ np.log((1 - self.on_good) / self.on_bad) + good_votes @ np.log(self.on_good / (1 - self.on_bad))
            good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        self.posterior = {tuple(p): float(g) for p, g in zip(patterns.tolist(), good)}


def shape(data: bytes) -> bytes:
    """Classes of the bytes; a word that repeats the one before it becomes one byte of a class of its own."""
    words = data.split()
    again = [k for k, same in enumerate(map(eq, words, words[1:]), 1) if same]
    if again:
        for k in again:
            words[k] = b"\x01"
        data = b" ".join(words)
    return data.translate(_SHAPE)


def shape_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the n-grams of the texts' character classes."""
    shapes = [shape(x.encode()) for x in texts]
    sizes = np.fromiter(map(len, shapes), np.int64, len(shapes))
    data = np.frombuffer(b"".join(shapes), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    code, rows, slots = np.zeros(len(data), np.uint32), [], []
    for n in ORDERS:
        code = code[: max(0, len(data) - n + 1)] | (data[n - 1 :] << np.uint32(8 * (n - 1)))
        inside = owner[: len(code)] == owner[n - 1 :]
        mixed = (code + np.uint32(n << 28)) * np.uint32(0x9E3779B1)
        slots.append((mixed >> np.uint32(32 - 12)).astype(np.int32)[inside])
        rows.append(owner[: len(code)][inside])
    return np.concatenate(rows), np.concatenate(slots)


class Scorer:
    """Logistic regression on the square roots of slot frequencies."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @staticmethod
    def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, slots = shape_grams(texts)
        cells, n = np.unique(rows.astype(np.int64) * SLOTS + slots, return_counts=True)
        rows, slots = cells // SLOTS, cells % SLOTS
        total = np.bincount(rows, n, len(texts))
        return rows, slots, np.sqrt(n / np.maximum(1, total[rows]))

    @classmethod
    def fit(cls, parts: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> Scorer:
        """``parts``: slots and values of each document."""
        rows = np.repeat(np.arange(len(parts)), [len(s) for s, _ in parts])
        slots = np.concatenate([s for s, _ in parts]) if parts else np.empty(0, np.int64)
        values = np.concatenate([v for _, v in parts]) if parts else np.empty(0)
        w, b = np.zeros(SLOTS), 0.0
        # both classes weigh the same
        good = max(1e-9, target.sum())
        bad = max(1e-9, (1 - target).sum())
        weight = (target / good + (1 - target) / bad) / 2
        for _ in range(STEPS if len(parts) else 0):
            z = np.bincount(rows, w[slots] * values, len(parts)) + b
            miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * weight
            w -= RATE * (np.bincount(slots, miss[rows] * values, SLOTS) + DECAY * w)
            b -= RATE * miss.sum()
        return cls(np.append(w, b))

    def score(self, texts: list[str]) -> np.ndarray:
        rows, slots, values = self.features(texts)
        z = np.bincount(rows, self.weights[slots] * values, len(texts)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[WeakLabels, Scorer]:
    """Weak-label model over all documents, and the scorer fitted on a sample of about ``sample``.

    Texts without words carry no vote and take no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")

    def tally(frames):
        seen: dict[tuple, int] = {}
        for frame in blocks(frames, "text"):
            for text in frame["text"]:
                v = votes(text)
                seen[v] = seen.get(v, 0) + 1
        if seen:
            yield pd.DataFrame({"votes": [list(v) for v in seen], "n": list(seen.values())})

    counted = rows.mapInPandas(tally, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).limit(3**8).collect()
    counted = sorted((tuple(r["votes"]), r["n"]) for r in counted if any(r["votes"]))
    patterns = np.array([v for v, _ in counted], np.int64).reshape(-1, 8)
    counts = np.array([n for _, n in counted], float)
    weak = WeakLabels(patterns, counts)
    share = min(1.0, sample / max(1.0, counts.sum()))
    posterior = docs.sparkSession.sparkContext.broadcast(weak.posterior)

    def draw(frames):
        for frame in blocks(frames, "text"):
            targets = [posterior.value.get(votes(x), -1.0) for x in frame["text"]]
            of, slots, values = Scorer.features(frame["text"].tolist())
            cut = np.searchsorted(of, np.arange(1, len(frame)))
            yield pd.DataFrame({
                "target": targets,
                "slots": [x.astype(np.int16).tobytes() for x in np.split(slots, cut)],
                "vals": [x.astype(np.float32).tobytes() for x in np.split(values, cut)],
            })

    million = 1_000_000
    drawn = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(million)) < F.lit(int(np.ceil(share * million))))
    got = [r for r in drawn.mapInPandas(draw, "target double, slots binary, vals binary").collect() if r["target"] >= 0]
    parts = [(np.frombuffer(r["slots"], np.int16).astype(np.int64), np.frombuffer(r["vals"], np.float32).astype(float)) for r in got]
    return weak, Scorer.fit(parts, np.array([r["target"] for r in got]))


def scores(docs: DataFrame, scorer: Scorer, text_col: str = "text"):
    """Column with the probability that a text is good; null, empty and blank texts score 0."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = []
        for frame in blocks(iter([pd.DataFrame({"text": text})]), "text"):
            texts = frame["text"].tolist()
            out.append(np.where([bool(x.strip()) for x in texts], scorer.score(texts), 0.0))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score(F.col(text_col))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, keep) of every row; repeated rows score alike; other columns are not read."""
    _, scorer = fit(docs, id_col, text_col, sample)
    scored = docs.select(F.col(id_col), scores(docs, scorer, text_col).alias("score"))
    return scored.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the classifier accepts."""
    _, scorer = fit(docs, id_col, text_col, sample)
    return docs.where(scores(docs, scorer, text_col) >= threshold)


def op8_quality_classifier(spark, sf_dir) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
