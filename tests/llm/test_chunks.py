import hashlib
import random

import pytest

from quillon.llm.chunks import _GEAR, EARLY_BITS, LATE_BITS, MAX_BYTES, MIN_BYTES, WANTED_BYTES, containment, chunk_set, cuts, fingerprint, op2_document_fingerprints


def docs(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as guard", "'x' as at").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(20000))
    ends = cuts(data)
    assert ends[-1] == len(data) and all(0 < b - a <= MAX_BYTES for a, b in zip([0, *ends], ends))
    moved = data[:5000] + b"inserted" + data[5000:]
    assert containment(chunk_set(data), chunk_set(moved)) > 0.95
    assert cuts(b"") == [] and fingerprint(None) == fingerprint("") == ""
    assert cuts(b"a" * 100000)[-1] == 100000


def plain_cuts(data):
    """Byte at a time: a rolling gear hash of 32 bits, whose upper bits decide."""
    ends, start, h = [], 0, 0
    for p, byte in enumerate(data, 1):
        h = ((h << 1) + int(_GEAR[byte])) & 0xFFFFFFFF
        if p - start > MAX_BYTES:
            start += MAX_BYTES
            ends.append(start)
        size = p - start
        if size >= MIN_BYTES and (h >> 32 - EARLY_BITS == 0 or (h >> 32 - LATE_BITS == 0 and size >= WANTED_BYTES)):
            ends.append(p)
            start = p
    return ends + [len(data)] * (start < len(data))


def plain_likeness(a, b):
    """Chunks as strings: length of a's distinct chunks that b has too, over that of all of a's."""
    parts = lambda data: {data[x:y] for x, y in zip([0, *plain_cuts(data)], plain_cuts(data))}
    own, other = parts(a), parts(b)
    total = sum(map(len, own))
    return sum(len(c) for c in own & other) / total if total else float(not other)


def test_chunks_and_likeness_equal_a_plain_chunker():
    rng = random.Random(7)
    words = [bytes(rng.choices(b"abcdefgh ", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [b" ".join(rng.choices(words, k=rng.choice([0, 1, 30, 900]))) for _ in range(24)] + [b"a" * (2 * MAX_BYTES + 5), bytes(rng.randrange(256) for _ in range(9000))]
    texts += [t[: len(t) // 2] + texts[k - 1][:200] + t[len(t) // 2 :] for k, t in enumerate(texts)]
    for t in texts:
        assert cuts(t) == plain_cuts(t)
    for a, b in zip(texts, texts[1:] + texts[26:]):
        assert containment(chunk_set(a), chunk_set(b)) == pytest.approx(plain_likeness(a, b))


def test_blocks_do_not_change_the_cuts(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(50000))
    whole = cuts(data)
    monkeypatch.setattr("quillon.llm.chunks.BLOCK_BYTES", 1000)
    assert cuts(data) == whole


@pytest.mark.parametrize("n", [0, 1, 2, 90])
def test_query_pairs_each_document_with_the_next(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6) if k % 7 else 10 * k, "".join(rng.choice("abcé 😀") for _ in range(rng.choice([0, 1, 5, 700])))) for k in range(n)]
    rows = [(d, None if k == 3 else t) for k, (d, t) in enumerate(rows)]
    if n == 90:
        rows += rows[:5] + [(rows[6][0], "other")]
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    want = []
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), containment(chunk_set(t.encode()), chunk_set(e.encode())), containment(chunk_set(t.encode()), chunk_set(u.encode()))))
    got = [tuple(r) for r in op2_document_fingerprints(spark, docs(spark, rows, tmp_path)).collect()]
    assert sorted(got) == sorted(want)
