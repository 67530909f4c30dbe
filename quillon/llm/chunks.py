"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where its masked bits are
zero.  The mask is normalised: before the wanted size more bits must be zero,
after it fewer, and sizes are held between a minimum and a maximum, so sizes
gather around the wanted one while boundaries still depend on the content of
the last 32 bytes only.  An insertion thus moves the boundaries next to it and
no others.  The fingerprint is the set of chunk digests with their lengths.

The hash of all positions of a block of texts is computed at once: five
doubling steps h += h[-2^k] << 2^k give the 32-byte window sum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import shuffle_partitions, table

MIN_BYTES, WANTED_BYTES, MAX_BYTES = 16, 64, 256
#: Zero bits asked for before and after the wanted size.
EARLY_BITS, LATE_BITS = 7, 5
#: Hex digits of a digest and of a length in the fingerprint string.
DIGEST_HEX, LENGTH_HEX = 12, 3
#: Bytes hashed at once.
BLOCK_BYTES = 4 << 20
WINDOW = 32

_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 2024) >> 32 for b in range(256)], dtype=np.uint32)


def _late(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the late mask allows a cut, and which of them the early mask allows too."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    at = np.flatnonzero((h >> np.uint32(32 - LATE_BITS)) == 0)
    return at + 1, (h[at] >> np.uint32(32 - EARLY_BITS)) == 0


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    ends: list[int] = []
    n, start, base = len(data), 0, 0
    if not n:
        return ends
    while base < n:
        low = max(0, base - WINDOW)
        at, early = _late(data[low : base + BLOCK_BYTES])
        keep = at > base - low
        last = base + BLOCK_BYTES >= n
        for p, strict in zip((at[keep] + low).tolist(), early[keep].tolist()):
            while p - start > MAX_BYTES:
                start += MAX_BYTES
                ends.append(start)
            size = p - start
            if size >= MIN_BYTES and (strict or size >= WANTED_BYTES):
                ends.append(p)
                start = p
        base += BLOCK_BYTES
        if last:
            break
    while n - start > MAX_BYTES:
        start += MAX_BYTES
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes) -> dict[str, int]:
    """Digest of each distinct chunk, with its length."""
    found, a = {}, 0
    shift = 64 - 4 * DIGEST_HEX
    digest = xxhash.xxh3_64_intdigest
    for b in cuts(data):
        found[digest(data[a:b]) >> shift] = b - a
        a = b
    return {f"{k:0{DIGEST_HEX}x}": v for k, v in found.items()}


def as_string(chunks: dict[str, int]) -> str:
    return "".join(f"{k}{v:0{LENGTH_HEX}x}" for k, v in sorted(chunks.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of a's length in chunks that b has too; two empty sets are equal, an empty and a full one are not."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    if len(b) < len(a):
        return sum(a[k] for k in b if k in a) / total
    return sum(v for k, v in a.items() if k in b) / total


def fingerprint(text: str | None) -> str:
    return as_string(chunk_set((text or "").encode()))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text; null texts count as empty, whose fingerprint is ''.

    Repeated rows stay; equal texts have equal fingerprints.  Other columns are
    not read.
    """

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "fingerprint": [fingerprint(x if isinstance(x, str) else "") for x in frame["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``work(id, text, next_text)`` to every document and the next one in descending id order.

    One shuffle of the texts.  A first pass over the ids alone finds the upper
    ends of as many ranges as there are shuffle partitions (real ids, at most
    that many values at the driver); a row goes to its range, and a row whose
    id is an upper end also goes, as a guard, to the range that comes before
    in descending order.  So a task that streams over its sorted ranges sees
    every row's successor and holds two rows at a time.  Null ids sort last;
    rows with equal ids are ordered by their text (nulls as empty).
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # null ids count as the smallest of all; the flag gives them back
    rows = rows.select("id", "text", F.coalesce("id", F.lit(-(2**63))).alias("at"))
    if parts > 1:
        share = F.percentile_approx("at", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(100 * parts))
        low = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("at")).agg(share.alias("q"), F.max("at").alias("top")).first()
    else:
        low = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("at")).agg(F.array().alias("q"), F.max("at").alias("top")).first()
    tops = np.unique(np.array([*(low["q"] or []), *([low["top"]] if low["top"] is not None else [])], dtype=np.int64))

    @F.pandas_udf("array<int>")
    def places(at: pd.Series) -> pd.Series:
        ids = at.to_numpy()
        home = np.searchsorted(tops, ids)
        guard = tops[home] == ids
        return pd.Series([[h, (h + 1) % len(tops)] if g else [h] for h, g in zip(home.tolist(), guard.tolist())])

    dealt = (
        rows.select("id", "text", "at", F.posexplode(places("at")).alias("guard", "part"))
        .repartitionById(max(1, len(tops)), F.col("part"))
        .sortWithinPartitions("part", F.col("guard") * F.lit(1), F.col("at").desc(), "text")
    )

    def stream():
        def run(frames):
            held, of = None, None  # the row that waits for its successor
            served = False  # whether the range's waiting row has met its guard
            for frame in frames:
                out = []
                for key, text, part, guard in zip(frame["id"], frame["text"], frame["part"], frame["guard"]):
                    if part != of:
                        held, of, served = None, part, False
                    if guard:
                        if held is not None and not served:
                            out.append(work(*held, text))
                            served = True
                        continue
                    if held is not None:
                        out.append(work(*held, text))
                    held = (key, text)
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(",")])

        return run

    return dealt.select("id", "text", "part", "guard").mapInPandas(stream(), schema)


def op2_document_fingerprints(spark, sf_dir) -> DataFrame:
    """Fingerprints of documents and of their half-exchanged texts, with containments."""

    def work(key, text, after):
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        own, other, following = chunk_set(text.encode()), chunk_set(edited), chunk_set(after.encode())
        return key, len(text), hashlib.sha256(edited).hexdigest(), as_string(own), as_string(other), containment(own, other), containment(own, following)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents"), work, schema)
