import random
import re

import pytest
import xxhash

from quillon.llm.simhash import simhash_bytes, simhash_groups


def brute_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = {k: brute_fp(t) for k, (_, t) in enumerate(rows)}
    parent = {f: f for f in fps.values()}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    all_fp = sorted(parent)
    for i, a in enumerate(all_fp):
        for b in all_fp[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = root(fps[k])
        least[r] = min(least.get(r, d), d)
    return sorted((d, f"{fps[k]:016x}", least[root(fps[k])]) for k, (d, _) in enumerate(rows))


def test_matches_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}É" for i in range(300)]
    rows = []
    for k in range(120):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 40, 400]))]
        rows.append((k, " ".join(words)))
        for c in range(rng.choice([0, 0, 1, 3])):
            w = list(words)
            if w and c:
                w[rng.randrange(len(w))] = "edit"
            rows.append((1000 + 10 * k + c, "\t".join(w).upper() if c == 2 else " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5002, " \n"), (5003, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as u", "4 as id")
    got = sorted(tuple(r) for r in simhash_groups(docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    docs = spark.createDataFrame([(None, None)][:n], "doc_id long, text string")
    assert [tuple(r) for r in simhash_groups(docs).collect()] == [(None, "0" * 16, None)][:n]


def test_large_near_group_keeps_links_without_all_pairs(spark):
    """A group of fingerprints in which each is near some, not all, of the others."""
    from quillon.llm.graph import components
    from quillon.llm.simhash import near_links

    rng = random.Random(3)
    fps = {0x0F0F_1234_5678_9ABC}
    while len(fps) < 1500:
        f = rng.choice(tuple(fps)[:200])
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(62)
        fps.add(f)
    fps = sorted(fps)
    links = near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {f: got.get(f, f) for f in fps} == {f: root(f) for f in fps}
    assert links.count() < 200_000


def test_fingerprint_of_words():
    for text in ("a b c d", "A  b\tC", "one", "", "x " * 100):
        assert simhash_bytes(text.encode()) == brute_fp(text)
