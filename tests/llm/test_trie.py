import hashlib
import math
import random
import zlib

import pytest

from quillon.llm import trie
from quillon.llm.trie import conversation_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild):
    convs = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(conv, []).append((role or "", text or ""))
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: tuple(convs.get(c - int(math.fmod(c, 100)), [])[: heads[c]] + own[heads[c] :]) for c, own in convs.items()}
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(key)))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def result(df):
    assert df.columns == list(COLUMNS)
    return sorted(tuple(r) for r in df.collect())


def made_up(seed, n, depth):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(depth)):
            rows.append((c, t if t else rng.choice([0, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "bb", "", None])))
    return rows


@pytest.mark.parametrize("rebuild", [False, True])
def test_against_all_prefixes(spark, rebuild):
    rows = made_up(1, 260, 6) + [(None, 0, "user", "nobody's")] + [(c, t, "user", "same") for c in (700, 701, 702) for t in range(30)]
    rows += [(800 + k, t, "user", f"grows {t}") for k in range(12) for t in range(k)]  # each goes on where the one before ends
    rows += [(901, 0, "user", "long " * 50_000), (-3, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as depth", "3 as k1", "4 as path", "5 as pos")
    assert result(conversation_trie(turns, rebuild)) == brute(rows, rebuild)


def test_blocks_and_ranges(spark, monkeypatch):
    """One conversation has most rows: it is numbered in several ranges, its running values taken in several blocks."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "PIECE", 60)
    rows = [(5, t, "user", f"t{t}") for t in range(300)] + [(6, t, "user", f"t{t}") for t in range(150)] + [(100 + c, 0, "user", "t0") for c in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(conversation_trie(turns)) == brute(rows, False)


def test_repeated_rows_are_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")] * 3 + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [r[:2] + r[3:4] for r in result(conversation_trie(turns))] == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (1, 3, 1)]


def test_no_conversations(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert result(conversation_trie(turns, True)) == []


def test_turnless_root(spark):
    """Conversation 1 is rebuilt from nothing where conversation 0 is absent and its own turns are among its first h."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(conversation_trie(turns, True)) == brute(rows, True) and len(brute(rows, True)) == 1
