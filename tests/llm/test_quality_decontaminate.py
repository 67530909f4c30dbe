import math
import random
import re
from collections import Counter

import numpy as np

from quillon.llm.decontaminate import contaminated_pairs, decontaminate, op3_decontamination
from quillon.llm.quality import DECAY, EM_ROUNDS, RARE, RATE, STEPS, WeakLabels, keep_good, op8_quality_classifier, quality, shape, votes


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = op8_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r["keep"] for r in rows if r["quality"]], [r["keep"] for r in rows if not r["quality"]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def plain_scores(texts):
    """EM over single votes and logistic regression over dictionaries, in plain loops."""
    seen = Counter(votes(t) for t in texts)
    seen = {v: n for v, n in sorted(seen.items()) if any(v)}
    good = {v: 0.1 if -1 in v else 0.9 for v in seen}
    for _ in range(EM_ROUNDS):
        w1, w0 = {v: n * good[v] for v, n in seen.items()}, {v: n * (1 - good[v]) for v, n in seen.items()}
        prior = (sum(w1.values()) + 1) / (sum(seen.values()) + 2)
        said = lambda w, j, s: sum(x for v, x in w.items() if v[j] == s)
        on_bad = [(said(w0, j, -1) + 1) / (said(w0, j, -1) + said(w0, j, 1) + 4) for j in range(8)]
        on_good = [min(1 - 1e-6, max(1 - RARE, (said(w1, j, 1) + 1) / (said(w1, j, -1) + said(w1, j, 1) + 1))) for j in range(8)]
        for v in seen:
            odds = math.log(prior / (1 - prior))
            for j, s in enumerate(v):
                odds += math.log((1 - on_good[j]) / on_bad[j]) if s == -1 else math.log(on_good[j] / (1 - on_bad[j])) if s == 1 else 0
            good[v] = 1 / (1 + math.exp(-max(-500, min(500, odds))))

    def features(text):
        data, found = shape(text.encode()), Counter()
        for n in (1, 2, 3):
            for k in range(len(data) - n + 1):
                code = int.from_bytes(data[k : k + n], "little")
                found[((code + (n << 28)) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        total = sum(found.values())
        return {s: math.sqrt(c / total) for s, c in found.items()}

    rows = [(features(t), good[votes(t)]) for t in texts if votes(t) in good]
    yes, no = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    w, b = np.zeros(1 << 12), 0.0
    for _ in range(STEPS):
        step, bias = DECAY * w, 0.0
        for x, y in rows:
            z = sum(w[s] * v for s, v in x.items()) + b
            miss = (1 / (1 + math.exp(-z)) - y) * (y / yes + (1 - y) / no) / 2
            bias += miss
            for s, v in x.items():
                step[s] += miss * v
        w, b = w - RATE * step, b - RATE * bias
    return [1 / (1 + math.exp(-(sum(w[s] * v for s, v in features(t).items()) + b))) if t.strip() else 0.0 for t in texts]


def test_scores_equal_plain_loops(spark):
    rng = random.Random(3)
    words = ["the", "quick", "Brown", "fox", "jumps", "over", "it", "all", "and", "runs."]
    texts = [" ".join(rng.choices(words, k=rng.randint(12, 25))) + "." for _ in range(30)]
    texts += [" ".join(rng.choices(["###", "%%%", "$$", "BUY", "NOW!!"], k=15)) for _ in range(8)] + ["", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality(docs, sample=10**6).collect()}
    for k, want in enumerate(plain_scores(texts)):
        assert abs(got[k] - want) < 1e-4, (k, got[k], want)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (None, "A plain sentence, which is fine."), (5, "word " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as keep", "3 as n", "4 as votes")
    got = quality(docs).collect()
    assert len(got) == 6 and all(r["score"] == 0 and not r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
    assert set(keep_good(docs).columns) == set(docs.columns)
    assert quality(docs.limit(0)).count() == 0 and keep_good(docs.limit(0)).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    right = np.array([0.9, 0.7, 0.6])
    bad = np.where(truth[:, None], rng.random((20000, 3)) < 0.0005, rng.random((20000, 3)) < right)
    patterns, counts = np.unique(np.where(bad, -1, 1), axis=0, return_counts=True)
    model = WeakLabels(patterns, counts.astype(float))
    assert np.abs(model.on_bad - right).max() < 0.05 and abs(model.prior - 0.8) < 0.05
    assert votes("") == (0,) * 8


def brute(docs, items):
    """Exact containment of word shingles for all pairs."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    out = []
    for item, text in items:
        w = words(text)
        if not w:
            continue
        n = min(5, len(w))
        q = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for doc, body in docs:
            v = words(body)
            found = len(q & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)})
            if found >= 0.8 * len(q):
                out.append((doc, item, len(q), found))
    return sorted(out, key=repr)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([3, 5, 6, 9, 30, 70, 200])))) for k in range(60)] + [(100, None), (101, ""), (7, "twice the id"), (102, "W1")]
    docs = []
    for k in range(150):
        w = text(rng.choice([0, 4, 300, 4000]))
        for _ in range(rng.choice([0, 1, 2])):
            passage = rng.choice(items)[1]
            passage = (passage or "").upper().replace(" ", ", ").split()
            if len(passage) > 25 and rng.random() < 0.5:
                passage[rng.randrange(len(passage))] = "changed"
            if len(passage) > 60 and rng.random() < 0.3:
                passage = passage[: len(passage) // 2]
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((k, " ".join(w)))
    docs += [(500, None), (501, ""), docs[0], (None, items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as item", "3 as item_id")
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id")
    want = brute(docs, items)
    got = sorted([tuple(r)[:4] for r in contaminated_pairs(frame, tests).collect()], key=repr)
    assert len(want) > 50 and got == want
    kept = decontaminate(frame, tests)
    assert kept.columns == frame.columns
    hit = {d for d, *_ in want}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, _ in docs if d not in hit), key=repr)
    assert contaminated_pairs(frame.limit(0), tests).count() == 0 and contaminated_pairs(frame, tests.limit(0)).count() == 0


def test_query_on_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    read = lambda name: [(r[0], r[1]) for r in spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*(("doc_id", "text") if name == "documents" else ("item_id", "text"))).collect()]
    got = sorted([tuple(r)[:4] for r in op3_decontamination(spark, d).collect()], key=repr)
    assert got == brute(read("documents"), read("benchmark"))
