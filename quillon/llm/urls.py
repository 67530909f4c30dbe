"""URL filters: host and path rules, and a logistic regression for the rest.

A rule names a host and a path start; it fits its host and all subdomains.  The
longest fitting rule decides.  Where none fits, a logistic regression on hashed
character n-grams of host and path decides.  It is trained from a small labelled
URL table, whose size is bounded, on the driver; its weights (a few thousand
numbers) travel with the task.  Blocks of URLs are hashed and scored in numpy.
"""

from __future__ import annotations

import random
import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import table

FEATURES = 1 << 14
ORDERS = (3, 4, 5)
#: Most labelled URLs used for training; URLs that are scored together.
MAX_LABELLED, BLOCK = 10_000, 512
STEPS, RATE, DECAY = 1000, 20.0, 1e-4

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Topics of the labelled table: of pages to block and of ordinary ones.
BLOCKED = (
    "casino", "poker", "bets", "betting", "slots", "jackpot", "lottery", "pills", "pharma", "viagra",
    "adult", "xxx", "porn", "sex", "escort", "loan", "payday", "spam", "linkfarm", "backlinks",
    "ads", "adserver", "track", "tracker", "click", "popup", "crack", "keygen", "warez", "torrent",
    "replica", "cheap", "free-win", "win", "prize", "bonus", "doubler", "phish", "malware", "scam",
)
ORDINARY = (
    "library", "news", "museum", "garden", "docs", "school", "forum", "wiki", "city", "weather",
    "science", "history", "music", "travel", "kitchen", "sports", "health", "research", "college", "archive",
    "journal", "books", "nature", "photo", "theatre", "local", "shop", "team", "river", "market",
    "station", "bakery", "hotel", "clinic", "council", "print", "studio", "radio", "train", "bridge",
)
#: What stands around topics in hosts and paths of pages to block and of ordinary ones.
LURES = ("best", "buy", "cheap", "free", "top", "hot", "fast", "instant", "vip", "mega", "super", "real", "24", "365", "4u", "247", "deals", "online", "now", "club", "offers", "promo")
LURE_PATHS = ("buy-now", "go", "out", "aff", "promo", "landing", "signup-bonus", "order", "offer", "exit", "redirect", "deal")
CALM = ("city", "old", "north", "south", "green", "saint", "royal", "state", "county", "open", "village", "public", "first", "lake", "hill", "west", "friends-of", "society", "house", "group", "home", "guide")
CALM_PATHS = ("about", "contact", "events", "article", "archive", "help", "people", "visit", "reports", "issues", "staff", "calendar")
#: Parts that occur with either label, so that they tell nothing.
_FRONTS, _ENDS, _TONGUES = ("", "www.", "m.", "blog."), ("com", "org", "net"), ("en", "de", "fr", "es")
_PATHS = ("/{t}/{n}", "/{t}/{n}/", "/{t}/{n}.html", "/{t}/{n}?page=2&ref=x", "/{t}/{n}#top", "/{t}/{w}/{n}", "/{p}/{w}", "/{p}/{n}", "/{p}", "/")
#: Onsets, vowels and ends of syllables of invented words.
_ONSETS, _VOWELS, _CODAS = "b c d f g h j k l m n p r s t v w z bl br ch cl dr fl gr pl pr sh sl st th tr".split(), "a e i o u ai ea ou".split(), ["", "", "", "n", "r", "s", "t", "l", "nd", "st"]


def invented(rng: random.Random) -> str:
    """A word that means nothing: two or three syllables, or four to ten letters of any kind."""
    if rng.random() < 0.4:
        return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(4, 10)))
    return "".join(rng.choice(_ONSETS) + rng.choice(_VOWELS) + rng.choice(_CODAS) for _ in range(rng.choice((2, 2, 3))))


def labelled_urls(copies: int = 16, blocked=BLOCKED, ordinary=ORDINARY) -> list[tuple[str, str]]:
    """The small labelled table (url, verdict), made by a rule from topics and what commonly stands around them.

    A host is a topic, two, or a topic with one or two words of its verdict's
    kind before or behind it; pages to block join them by hyphens more often.
    Two in three ordinary hosts are invented words, so that what the model has
    never seen is allowed.  Fronts, ends, languages and numbers are dealt alike.
    """
    rows = []
    for verdict, topics, around, paths, hyphens in (("block", blocked, LURES, LURE_PATHS, 0.7), ("allow", ordinary, CALM, CALM_PATHS, 0.3)):
        for topic in topics:
            for c in range(copies):
                rng = random.Random(f"{verdict} {topic} {c}")
                parts = [topic]
                if verdict == "allow" and c % 3:
                    parts = [invented(rng) for _ in range(rng.choice((1, 1, 2)))]
                elif rng.random() < 0.15:
                    parts.append(rng.choice(topics))
                elif rng.random() < 0.9:
                    parts += rng.sample(around, rng.choice((1, 2)))
                rng.shuffle(parts)
                name = ("-" if rng.random() < hyphens else "").join(parts)
                path = rng.choice(_PATHS).format(t=rng.choice(_TONGUES), n=rng.randrange(1000), w=topic if topic in parts else invented(rng), p=rng.choice(paths))
                rows.append((f"https://{rng.choice(_FRONTS)}{name}.example.{rng.choice(_ENDS)}{path}", verdict))
    return rows


LABELLED = tuple(labelled_urls())


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if not isinstance(url, str) or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


class Rules:
    """Rules by host; a lookup walks those suffixes of a host that are no longer than the longest rule host."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((len(host + path), path, host + path, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda r: (-r[0], r[2], r[3]))
        self.longest = max(map(len, self.by_host), default=0)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        at = 0 if len(host) <= self.longest else host.find(".", len(host) - self.longest - 1) + 1 or -1
        while at >= 0:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule[1]):
                    if best is None or rule[0] > best[0]:
                        best = rule
                    break
            at = host.find(".", at) + 1 or -1
        return best and best[2:]


def features(urls: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(url number, slot) of the distinct hashed n-grams of ``^host$`` and ``path$`` of each (host, path)."""
    texts = [part for host, path in urls for part in (f"^{host}$".encode(), f"{path}$".encode())]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    code, cells = np.zeros(len(data), np.uint64), []
    for n in range(1, max(ORDERS) + 1):
        code = code[: max(0, len(data) - n + 1)] | (data[n - 1 :] << np.uint64(8 * (n - 1)))
        if n not in ORDERS:
            continue
        inside = owner[: len(code)] == owner[n - 1 :]
        mark = (owner[: len(code)] % 2).astype(np.uint64) << np.uint64(44)  # host and path have slots of their own
        mixed = (code + mark + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        slots = (mixed >> np.uint64(64 - (FEATURES - 1).bit_length())).astype(np.int64)
        cells.append((owner[: len(code)] // 2 * FEATURES + slots)[inside])
    found = np.unique(np.concatenate(cells)) if cells else np.empty(0, np.int64)
    return found // FEATURES, found % FEATURES


def _scaled(rows: np.ndarray, n: int) -> np.ndarray:
    """One over the root of the number of slots of each URL."""
    return 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))


def train(labelled) -> np.ndarray:
    """Weights, the bias last, by full-batch gradient descent with weight decay."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    rows, slots = features([split_url(u) for u, _ in labelled])
    scale = _scaled(rows, len(labelled))
    y = np.array([v == "block" for _, v in labelled], float)
    w, b = np.zeros(FEATURES), 0.0
    for _ in range(STEPS if len(labelled) else 0):
        z = np.bincount(rows, w[slots], len(labelled)) * scale + b
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        w -= RATE * (np.bincount(slots, (miss * scale)[rows], FEATURES) / len(labelled) + DECAY * w)
        b -= RATE / 10 * miss.mean()
    return np.append(w, b)


def probabilities(weights: np.ndarray, urls: list[tuple[str, str]]) -> np.ndarray:
    """Probabilities of block of (host, path) pairs; an empty one is judged by its two marks and the bias."""
    rows, slots = features(urls)
    z = np.bincount(rows, weights[slots], len(urls)) * _scaled(rows, len(urls)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    A null URL, or one without ``://``, has empty host and path and fits no
    rule; the model judges it like any other.  Repeated rows and ties stay row
    by row; rules of equal length: the first in order of their text.
    """
    weights = train(labelled)
    known = Rules(tuple(rules))

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), BLOCK):
                part = frame.iloc[a : a + BLOCK]
                urls = [split_url(u) for u in part["url"]]
                scores = probabilities(weights, urls).tolist()
                hits = [known.find(*u) for u in urls]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(),
                    "host": [h for h, _ in urls],
                    "path": [p for _, p in urls],
                    "rule": [hit[0] if hit else None for hit in hits],
                    "verdict": [hit[1] if hit else "block" if p >= threshold else "allow" for hit, p in zip(hits, scores)],
                    "score": scores,
                })

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    return rows.mapInPandas(run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)


def op7_url_filter(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
