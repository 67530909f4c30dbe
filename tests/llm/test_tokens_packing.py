import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm.packing import _Stock, dominated, op4_best_fit_packing, pack, plan, sequences, solve, token_pieces
from quillon.llm.tokens import Encoder, default_path, prove, token_counts

TEXTS = ["", None, "  ", "a  b\n\n c", "x<|endoftext|> y<|endoftext|>", "日本語 テスト", "don't we'll I'VE 12 12a \x1c\x1d \x85\xa0 z", "é" * 5000, " " * 3000 + "a", "a\t\n b", " \n<|endoftext|>", "ǅ ª² ½ ſ", "word " * 9000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_counts_equal_the_library(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, "")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_bytes")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs).collect()}
    for k, text in enumerate(TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[k] == (len((text or "").encode()), n, n > 512)
    assert token_counts(docs.limit(0)).count() == 0


def test_proven_tokens_and_random_texts(library):
    proof = prove(default_path())
    assert len(proof.proven) > 45_000
    own = Encoder(proof, ids=True)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["the ", " in", "É", "'s", "9", "\n", "  ", "zq", "!", "€", "<|endoftext|>", "\t", "ß", "ing"]) for _ in range(60))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def fits_into(small, large):
    """Whether the items of small can be packed into items of large as bins, by trying all ways."""
    if not small:
        return True
    return any(small[0] <= room and fits_into(small[1:], (*large[:k], room - small[0], *large[k + 1 :])) for k, room in enumerate(large))


def all_fillings(items, room):
    found = {()}
    for x in items:
        found |= {tuple(sorted((*f, x), reverse=True)) for f in found if sum(f) + x <= room}
    return found


def test_fillings_are_undominated():
    assert fits_into((3, 2), (5,)) and not fits_into((3, 3), (5,)) and fits_into((2, 2, 1), (3, 2))
    rng = random.Random(5)
    for _ in range(40):
        items, room = [rng.randint(1, 9) for _ in range(rng.randint(1, 7))], rng.randint(1, 16)
        every = all_fillings(items, room)
        best = {f for f in every if not any(g != f and fits_into(f, g) and not (fits_into(g, f) and len(g) > len(f)) for g in every)}
        for even in (False, True):
            stock = _Stock(Counter(items), 20)
            listed = list(stock.fillings(room, even, False))
            found = [f for f in listed if f is not None]
            assert len(set(found)) == len(found) and [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)
            assert set(found) == best, (items, room)
            assert set(_Stock(Counter(items), 20).fillings(room, even, True)) == every
    assert dominated((2, 2), 0, 1 << 4) and not dominated((4,), 0, 1 << 2) and dominated((), 3, 1 << 3)


def optimum(items, capacity):
    """Exact number of bins by search over all assignments."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for j in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            go(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_solver_reaches_the_optimum_of_small_cases():
    rng = random.Random(11)
    for _ in range(60):
        items = [rng.randint(1, 60) for _ in range(rng.randint(0, 11))]
        patterns = solve(dict(Counter(items)), 100)
        assert sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in patterns), Counter()) == Counter(items)
        assert all(sum(p) <= 100 for p, _ in patterns)
        assert sum(n for _, n in patterns) == optimum(items, 100)


def test_narrow_histogram_is_near_its_bound():
    rng = np.random.default_rng(1)
    histogram = Counter(np.clip(rng.lognormal(5.9, 0.3, 48_000).astype(int), 1, 2048).tolist())
    patterns = solve(histogram)
    bound = -(-sum(x * n for x, n in histogram.items()) // 2048)
    assert sum(n for _, n in patterns) <= bound * 1.003
    assert sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in patterns), Counter()) == histogram


def test_names_of_the_caller_do_not_clash(spark):
    pieces = spark.createDataFrame([(1, 0, 5, 7, 8, 9, "a"), (2, 0, 6, 7, 8, 9, "b")], "doc_id int, piece int, length long, salt int, rank int, row int, `a.b` string")
    packed = pack(pieces, capacity=12)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted((r["doc_id"], r["salt"], r["rank"], r["row"], r["a.b"]) for r in packed.collect()) == [(1, 7, 8, 9, "a"), (2, 7, 8, 9, "b")]


def test_large_histogram_is_near_its_bound():
    rng = random.Random(1)
    histogram = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(100_000))
    patterns = solve(histogram)
    bound = -(-sum(x * n for x, n in histogram.items()) // 2048)
    assert sum(n for _, n in patterns) <= bound * 1.002 + 1
    assert len(patterns) < 8000


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_query_places_every_piece(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, ""), (None, "null id")], "doc_id long, text string").selectExpr("*", "1 as piece", "2 as __salt")
    packed = pack(token_pieces(docs, with_ids=True))
    rows = packed.collect()
    check(rows, 2048)
    for k, text in enumerate(TEXTS[1:], 1):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [i for r in own for i in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(r["length"] == 2048 for r in own[1:]) and [r["start"] for r in own] == [sum(q["length"] for q in own[:j]) for j in range(len(own))]
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in own)
    assert sum(r["n_tokens"] for r in sequences(packed).collect()) == sum(r["length"] for r in rows)
    assert pack(token_pieces(docs.limit(0))).count() == 0


def test_query_on_the_small_table(spark):
    rows = op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    check(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 1


def test_plan_gives_each_rank_one_place():
    places = plan([((5, 3, 3), 4), ((3,), 2)])
    assert places[3].tolist() == [[0, 4, 0, 5], [4, 4, 0, 8], [8, 2, 4, 0]]
