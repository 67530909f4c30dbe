import random

import corpus_pipeline
from quillon.llm import jaccard


def brute(rows):
    """Ids that stay, by all-pairs Jaccard of 5-word shingles."""

    def cut(text):
        w = (text or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [cut(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), d), d)
    return sorted(least.values())


def near_copies(seed=3):
    """Copies with last words or middle words changed, around the bound of 0.8; short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    texts = ["", " ", "one two", "One  two", "one two three four five", "a b c d e f"]
    for base in range(25):
        w = rng.choices(words, k=rng.randint(20, 300))
        texts.append(" ".join(w))
        for copy in range(5):
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                v[rng.choice([-1, rng.randrange(len(v))])] = rng.choice(words)
            texts.append(" ".join(v))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_matches_all_pairs(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == brute(rows)


def test_large_keys_match_all_pairs(spark, monkeypatch):
    """Stars first, then pairs across components, in small blocks."""
    monkeypatch.setattr(jaccard, "SIDE", 3)
    rows = near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.one_per_similar(docs).collect()) == brute(rows)


def test_last_word_differs(spark):
    w = [f"word{k}" for k in range(64)]
    docs = spark.createDataFrame([(2, " ".join(w)), (56, " ".join([*w[:-1], "other"]))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()] == [2]


def test_one_row_stays_of_repeated_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words are here now"), (2, "a b c d"), (None, "alone in the world of ids"), (None, "alone in the world of ids"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __n", "2 as fp")
    kept = jaccard.one_per_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [(0, "alone in the world of ids"), (1, "a b c d"), (1, "other words are here now"), (3, None)]


def test_stage_links_by_simhash_first(spark, monkeypatch):
    """Without the prefix join the stage finds what SimHash finds within three bits, less what is not similar; groups known from it are not paired again."""
    from quillon.llm.simhash import simhash_bytes

    refrain, tail = "over and over the same nine words come again ", lambda k: " ".join(f"t{k}{j}" for j in range(12))
    rows = near_copies(7)
    rows += [(len(rows) + k, refrain * 60 + tail(k)) for k in range(2)]
    sims = [simhash_bytes(t.encode(), 5) for _, t in rows]
    assert (sims[-1] ^ sims[-2]).bit_count() <= 3 and len(brute(rows[-2:])) == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, seen = jaccard._candidates, []

    def none(dealt, similarity):
        return whole(dealt, similarity).where("false")

    monkeypatch.setattr(jaccard, "_candidates", none)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s.lower().split() == t.lower().split() or (sims[a] ^ sims[b]).bit_count() <= 3 and len(brute([(a, s), (b, t)])) == 1:
                a_, b_ = sorted((root(a), root(b)))
                parent[b_] = a_
    assert kept == {root(k) for k, _ in rows} and len(brute(rows)) < len(kept) < len({" ".join(t.lower().split()) for _, t in rows})

    monkeypatch.setattr(jaccard, "_candidates", whole)
    likely = jaccard._likely
    monkeypatch.setattr(jaccard, "_likely", lambda pairs, *more: seen.append({frozenset((r["u"], r["v"])) for r in pairs.collect()}) or likely(pairs, *more))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == brute(rows)
    sequence = {k: int(jaccard._sequences([t.encode()])[0]) for k, t in rows}
    assert not any(frozenset((sequence[k], sequence[root(k)])) in pairs for pairs in seen for k in parent if sequence[k] != sequence[root(k)])
