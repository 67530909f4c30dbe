"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the 1- to
4-grams of the UTF-8 bytes are hashed into a fixed number of slots.  Training is
one pass: every task adds up slot counts for each label and emits the non-zero
ones, which Spark sums; the resulting matrix of labels by slots is small (its
size is checked) and is broadcast.  Scoring adds the log-probabilities of a
text's distinct slots, weighted by their counts, for whole blocks in numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blocks, table

SLOTS = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Most labels that a model may have; bounds the broadcast matrix.
MAX_LABELS = 512
SMOOTHING = 0.5
#: Bytes of a text from which on it is counted in pieces of that size.
LONG = 1 << 20
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    """Letters (Unicode categories L) in lower case between single spaces; empty if there are none."""
    kept = _OTHER.sub(" ", text)
    if not kept.replace(" ", "").isalpha():  # word characters that are no letters, such as fractions
        kept = " ".join("".join(c if c.isalpha() else " " for c in kept).split())
    kept = kept.strip().lower()
    return f" {kept} ".encode() if kept else b""


def hashed_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every n-gram of every text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    code, rows, slots = np.zeros(len(data), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        code = code[: len(data) - n + 1] | (data[n - 1 :] << np.uint64(8 * (n - 1)))
        if n not in ORDERS or not len(code):
            continue
        inside = owner[: len(code)] == owner[n - 1 :]
        mixed = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        slots.append((mixed >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int32)[inside])
        rows.append(owner[: len(code)][inside])
    return (np.concatenate(rows), np.concatenate(slots)) if rows else (np.empty(0, np.int32), np.empty(0, np.int32))


def slot_counts(data: bytes, limit: int = LONG) -> np.ndarray:
    """Counts of the slots of one text's n-grams, gathered over pieces of ``limit`` bytes."""
    counts, reach = np.zeros(SLOTS, np.int64), max(ORDERS) - 1
    for a in range(0, len(data), limit):
        # grams that start in the piece: those of the piece and its overlap less those of the overlap alone
        piece, overlap = data[a : a + limit + reach], data[a + limit : a + limit + reach]
        counts += np.bincount(hashed_grams([piece])[1], minlength=SLOTS)
        counts -= np.bincount(hashed_grams([overlap])[1], minlength=SLOTS)
    return counts


def train(labelled: DataFrame, label_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Labels in order, and log-probabilities of the slots with the log-prior as the last column.

    Learns from every row that has a label and a letter; no rows give no labels.
    """

    def count(frames):
        sums: dict[str, np.ndarray] = {}
        for frame in blocks(frames, "text"):
            texts = [normalise(x) for x in frame["text"]]
            rows, slots = hashed_grams([t if len(t) <= LONG else b"" for t in texts])
            own = frame["label"].astype(str).to_numpy()
            for k, text in enumerate(texts):
                if len(text) > LONG:
                    sums.setdefault(own[k], np.zeros(SLOTS + 1, np.int64))[:SLOTS] += slot_counts(text)
            labels, code = np.unique(own, return_inverse=True)
            flat = np.bincount(code[rows].astype(np.int64) * SLOTS + slots, minlength=len(labels) * SLOTS).reshape(-1, SLOTS)
            full = np.bincount(code[np.array([bool(t) for t in texts], bool)], minlength=len(labels))
            for k, label in enumerate(labels.tolist()):
                sums.setdefault(label, np.zeros(SLOTS + 1, np.int64))[:] += np.append(flat[k], full[k])
        for label, values in sums.items():
            at = np.flatnonzero(values)
            yield pd.DataFrame({"label": label, "slot": at.astype(np.int32), "n": values[at]})

    rows = labelled.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null")
    counts = rows.mapInPandas(count, "label string, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n"))
    by_label = counts.groupBy("label").agg(F.collect_list(F.struct("slot", "n")).alias("counts")).limit(MAX_LABELS + 1).toPandas()
    if len(by_label) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    by_label = by_label.sort_values("label")
    matrix = np.zeros((len(by_label), SLOTS + 1))
    for k, pairs in enumerate(by_label["counts"]):
        for pair in pairs:
            matrix[k, pair["slot"]] = pair["n"]
    seen = matrix[:, SLOTS] > 0
    matrix, labels = matrix[seen], [x for x, s in zip(by_label["label"], seen) if s]
    if labels:
        grams = matrix[:, :SLOTS] + SMOOTHING
        matrix = np.hstack([np.log(grams / grams.sum(axis=1, keepdims=True)), np.log(matrix[:, SLOTS:] / matrix[:, SLOTS].sum())])
    return labels, matrix


def score(texts: list[str], labels: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Best label and its posterior; texts without a letter, and all texts of an empty model, are ``und`` with 0."""
    clean = [normalise(x) for x in texts]
    if not labels or not texts:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows, slots = hashed_grams([t if len(t) <= LONG else b"" for t in clean])
    cells, n = np.unique(rows.astype(np.int64) * SLOTS + slots, return_counts=True)
    rows, slots = cells // SLOTS, cells % SLOTS
    logs = np.stack([np.bincount(rows, n * matrix[k, slots], len(texts)) + matrix[k, SLOTS] for k in range(len(labels))], axis=1)
    for k, text in enumerate(clean):
        if len(text) > LONG:
            logs[k] += matrix[:, :SLOTS] @ slot_counts(text)
    best = logs.argmax(axis=1)
    posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return [labels[b] if t else UNKNOWN for b, t in zip(best, clean)], [float(p) if t else 0.0 for p, t in zip(posterior, clean)]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, keep, lang_pred, score) of every row.

    Null, empty and letterless texts are ``und``; ties go to the first label in
    order; repeated rows stay; only the id, the text and ``keep`` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        labels, matrix = shared.value
        for frame in blocks(frames, "text"):
            best, how = score(frame["text"].tolist(), labels, matrix)
            yield pd.DataFrame({"id": frame["id"], "keep": frame["keep"], "lang_pred": best, "score": how})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(True) if keep is None else keep).alias("keep"))
    return rows.mapInPandas(run, f"id {kind}, keep boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op6_language_id(spark, sf_dir) -> DataFrame:
    """Predictions for all documents by a model of those whose crc32(doc_id) mod 4 is not 2 (null ids: learned from, not held out)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return identify(docs, model, keep=held_out).withColumnRenamed("keep", "held_out")
