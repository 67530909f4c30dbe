import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import suffixes
from quillon.llm.suffixes import LoserTree, digest, front_code, gram_hashes, op5_suffix_dedup, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(d), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def sample(rng, n):
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 90))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randint(1, len(p))])
        out.append(" ".join(parts))
    return out + out[:3] + [None, "", "x" * 150, "y" * 900, "ab" * 400]


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.choice([0, 1, 30]))) for _ in range(7)]
    merged = [(s, k) for _, _, s, k in LoserTree([front_code(r) for r in runs])]
    assert [s for s, _ in merged] == sorted(s for r in runs for s in r)
    for (a, _), (b, k) in zip(merged, merged[1:]):
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert k == want


def test_gram_hashes_depend_on_the_gram_alone():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    for gram in (5, 8, 50):
        h = gram_hashes(data, gram)
        by = {}
        for k, v in enumerate(h.tolist()):
            assert by.setdefault(data[k : k + gram].tobytes(), v) == v
        assert len(set(by.values())) == len(by)


@pytest.mark.parametrize(("length", "gram", "block", "run"), [(200, 50, 4 << 20, 48 << 20), (40, 10, 500, 2000)])
def test_removal_equals_brute_force(spark, monkeypatch, length, gram, block, run):
    texts = sample(random.Random(length), 60)
    rows = [(k if k < 62 else 1, t) for k, t in enumerate(texts)] + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as k1", "3 as spans", "4 as id").repartition(5)
    monkeypatch.setattr(suffixes, "RUN_BYTES", run)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    got = sorted(((r["doc_id"], r["n_bytes"], [(s["begin"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in remove_repeats(docs, length=length, gram=gram).collect()), key=repr)
    want = sorted(((d, *w) for (d, _), w in zip(rows, brute([t for _, t in rows], length))), key=repr)
    assert got == want
    assert any(w[2] for w in want)


def test_empty_table_and_query(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0
    d = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted((k, n, sum(b - a for a, b in s), len(s), digest(kept)) for (k, _), (n, s, kept) in zip(texts, brute([t for _, t in texts], 200)))
    assert sorted(tuple(r) for r in op5_suffix_dedup(spark, d).collect()) == want
