import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import language
from quillon.llm.language import identify, normalise, op6_language_id, score, slot_counts, train
from quillon.llm.urls import BLOCKED, FEATURES, LABELLED, MAX_LABELLED, ORDINARY, RULES, filter_urls, labelled_urls, op7_url_filter, probabilities, split_url, train as train_urls

MASK = (1 << 64) - 1


def slot(data, mark=0, bits=14):
    """One n-gram's slot in plain integers."""
    code = int.from_bytes(data, "little") + (mark << 44) + (len(data) << 40)
    return (code * 0x9E3779B97F4A7C15 & MASK) >> 64 - bits


def plain_text(text):
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text)
    return f" {' '.join(letters.split())} ".lower().encode() if letters.strip() else b""


def grams(data, orders=(1, 2, 3, 4)):
    return Counter(slot(data[k : k + n]) for n in orders for k in range(len(data) - n + 1))


def test_naive_bayes_equals_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs] + [(9001, "½ ² Ⅷ 12", "en"), (9002, "Ⅷ½ año_nuevo", "es"), (9003, None, "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(frame)
    sums, sizes = {}, Counter()
    for _, text, lang in rows:
        if data := plain_text(text or ""):
            sums.setdefault(lang, Counter()).update(grams(data))
            sizes[lang] += 1
    got = {r["doc_id"]: r for r in identify(frame, model).collect()}
    for key, text, _ in rows:
        data = plain_text(text or "")
        assert normalise(text or "") == data
        if not data:
            assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
            continue
        logs = {}
        for lang, n in sums.items():
            total = sum(n.values()) + 0.5 * (1 << 14)
            logs[lang] = math.log(sizes[lang] / sum(sizes.values())) + sum(k * math.log((n[s] + 0.5) / total) for s, k in grams(data).items())
        best = max(sorted(logs), key=logs.get)
        assert got[key]["lang_pred"] == best
        assert got[key]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-6)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    data = plain_text("Überall in der Welt steht das eine oder andere Wort " * 9)
    whole = np.zeros(1 << 14, np.int64)
    for s, k in grams(data).items():
        whole[s] = k
    for limit in (4, 7, 64, 10_000):
        assert (slot_counts(data, limit) == whole).all()
    matrix = np.log(np.random.default_rng(1).random((2, (1 << 14) + 1)))
    short = score([data.decode(), "x"], ["a", "b"], matrix)
    monkeypatch.setattr(language, "LONG", 16)
    assert score([data.decode(), "x"], ["a", "b"], matrix)[0] == short[0]
    assert score([data.decode(), "x"], ["a", "b"], matrix)[1] == pytest.approx(short[1])


def test_held_out_accuracy(spark):
    rows = op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges_of_language_id(spark):
    rows = [(1, "hello world there", "en"), (2, "bonjour le monde", "fr"), (3, None, "fr"), (4, "", None), (5, "123 !?", "en"), (6, "the world " * 20000, None), (6, "été", None), (None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as keep", "2 as label", "3 as id")
    got = {(r["doc_id"], r["lang_pred"]) for r in identify(docs, train(docs)).collect()}
    assert {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en")} <= got
    none = docs.limit(0)
    assert train(none)[0] == [] and identify(none, train(none)).count() == 0
    assert {r["lang_pred"] for r in identify(docs, train(none)).collect()} == {"und"}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a.example.com/en/1?x", ("a.example.com", "/en/1", "example.com/en/", "block")),
        ("http://WWW.Example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
        ("http://m.www.example.com/en/x#t", ("m.www.example.com", "/en/x", "www.example.com/en/", "allow")),
        ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        ("http://com/", ("com", "/", "com/", "allow")),
        ("http://com", ("com", "", None, None)),
        ("https://x.net/es/2", ("x.net", "/es/2", "net/es/", "block")),
        ("https://x.net/ES/2", ("x.net", "/ES/2", None, None)),
        ("https://x.net?u=/fr/", ("x.net", "", None, None)),
        ("mailto:x", ("", "", None, None)),
        ("", ("", "", None, None)),
        (None, ("", "", None, None)),
    ],
)
def test_rules(spark, url, want):
    from quillon.llm.urls import RULES, Rules

    host, path = split_url(url)
    hit = Rules(RULES).find(host, path)
    assert (host, path, *(hit or (None, None))) == want


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest, host = url.split("://", 1)[1], ""
    while rest and rest[0] not in "/?#":
        host, rest = host + rest[0], rest[1:]
    path = ""
    while rest and rest[0] not in "?#":
        path, rest = path + rest[0], rest[1:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_whole_query_equals_a_plain_one(spark):
    weights = train_urls(LABELLED)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: r for r in op7_url_filter(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for key, url in pages:
        host, path = plain_url(url)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        slots = {slot(f"^{host}$".encode()[k : k + n]) for n in (3, 4, 5) for k in range(len(host.encode()) + 3 - n)}
        slots |= {slot(f"{path}$".encode()[k : k + n], 1) for n in (3, 4, 5) for k in range(len(path.encode()) + 2 - n)}
        p = 1 / (1 + math.exp(-(sum(weights[s] for s in slots) / math.sqrt(max(1, len(slots))) + weights[-1])))
        rule, verdict = max(fits)[1:] if fits else (None, "block" if p >= 0.5 else "allow")
        r = got[key]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
        assert r["score"] == pytest.approx(p)
    assert FEATURES == 1 << 14


def recall_and_precision(weights, rows):
    hit = [x >= 0.5 for x in probabilities(weights, [split_url(u) for u, _ in rows])]
    both = sum(h and v == "block" for h, (_, v) in zip(hit, rows))
    return both / sum(v == "block" for _, v in rows), both / max(1, sum(hit))


#: Topics of neither list, looked at only here: the table's rule was chosen by folds of its own topics.
FRESH_BLOCKED = ("roulette", "baccarat", "steroids", "counterfeit", "bingo", "ransom", "hoax", "webcam", "miracle", "clickbait", "forex", "smut")
FRESH_ORDINARY = ("orchard", "chapel", "harbor", "poetry", "parish", "ferry", "chess", "bicycle", "geology", "knitting", "theology", "aquarium")


def test_topics_that_were_never_trained(spark):
    for fold in range(4):
        own = lambda topics, inside: [t for k, t in enumerate(topics) if (k % 4 == fold) == inside]  # noqa: E731, B023
        w = train_urls(labelled_urls(blocked=own(BLOCKED, False), ordinary=own(ORDINARY, False)))
        recall, precision = recall_and_precision(w, labelled_urls(blocked=own(BLOCKED, True), ordinary=own(ORDINARY, True)))
        print("fold", fold, recall, precision)
        assert recall >= 0.5 and precision >= 0.95, (fold, recall, precision)
    recall, precision = recall_and_precision(train_urls(LABELLED), labelled_urls(blocked=FRESH_BLOCKED, ordinary=FRESH_ORDINARY))
    print("fresh topics", recall, precision)
    assert recall >= 0.5 and precision >= 0.95


def test_labelled_table_and_edges(spark):
    assert LABELLED == tuple(labelled_urls()) and len(LABELLED) == 16 * (len(BLOCKED) + len(ORDINARY)) <= MAX_LABELLED
    recall, precision = recall_and_precision(train_urls(LABELLED), LABELLED)
    assert recall > 0.95 and precision > 0.95
    pages = spark.createDataFrame([(1, None), (1, "http://q.org/" + "a" * 50000), (2, "http://" + "a." * 50000 + "net/es/"), (None, "x")], "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    got = filter_urls(pages).collect()
    assert len(got) == 4 and [r["verdict"] for r in got if r["page_id"] == 2] == ["block"]
    assert filter_urls(pages.limit(0)).count() == 0
