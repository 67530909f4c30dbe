import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillon.llm import trie
from quillon.llm.repair import Layers, damage, repair

GRAMMAR = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        role, text = space(role), space(text)
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (1 + (k == 3))
    return out


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(turns, found):
    """From behind, with whole strings: least (cost, edits, repaired) from turn i on, given the initials so far."""

    @functools.cache
    def rest(i, state):
        given = 3 if state == 2 else 2
        role = "assistant" if state == 2 else "user"
        options = []
        if i == len(turns):
            if state in (0, 3):
                options.append((0, "", ()))
        else:
            cost, edits, out = rest(i + 1, state)
            options.append((cost + 4, "D" + edits, out))
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                cost, edits, out = rest(i + 1, given)
                options.append((cost + 3 + more, "R" + edits, ((role, turns[i][1]),) + out))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, turns[i][0][:1]))
                if kept:
                    cost, edits, out = rest(i + 1, kept)
                    options.append((cost + more, "K" + edits, (turns[i],) + out))
        if depth[0] < 3:
            depth[0] += 1
            cost, edits, out = rest.__wrapped__(i, given)
            options.append((cost + 3, "I" + edits, ((role, ""),) + out))
            depth[0] -= 1
        return min(options) if options else (10**9, "", ())

    depth = [0]
    for i in range(len(turns), -1, -1):
        for state in range(4):
            rest(i, state)
    return rest(0, 0)


def brute(rows, ids):
    out = []
    for conv in sorted(set(ids), key=lambda c: (c is not None, c or 0)):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns, numbers = [r[2:] for r in own], [r[1] for r in own if r[1] is not None]
        found = faults(turns)
        cost, audit, repaired = best(turns, found)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_layers_against_all_edits():
    """Every edit sequence of up to three turns, by enumeration."""
    layers = Layers()

    def every(signs, initials=""):
        if len(initials) > 6:
            return
        if not signs and GRAMMAR.fullmatch(initials):
            yield 0, ""
        for role in "ua":
            for cost, edits in every(signs, initials + role) if len(initials) < 6 else ():
                yield cost + 3, "I" + edits
        if signs:
            sign, more = signs[0], 3 * signs[0].isupper()
            for cost, edits in every(signs[1:], initials):
                yield cost + 4, "D" + edits
            if not sign.isdigit():
                for role in "ua":
                    for cost, edits in every(signs[1:], initials + role):
                        yield cost + 3 + more, "R" + edits
                for cost, edits in every(signs[1:], initials + sign.lower()):
                    yield cost + more, "K" + edits

    for n in range(4):
        for signs in itertools.product("suaUAo1", repeat=n):
            stack, cost = [0], 0
            for sign in signs:
                at, more, _ = layers.step(stack[-1], sign)
                stack.append(at)
                cost += more
            assert layers.answer(stack, "".join(signs), cost) == min(every(signs)), signs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["Fine.", "Cut off", "Ends! \n", " \t", "", None, "Again?", "é."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    out = []
    for c in range(150):
        for t in range(rng.randrange(9)):
            out.append((c, t if rng.random() < 0.9 else t + 3, rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[t % 2], rng.choice(texts)))
    return [r for k, r in enumerate(out) if not any(r[:2] == q[:2] for q in out[:k])]


def test_against_plain_program(spark, rows):
    rows = rows + [(None, 0, "user", "Nobody's."), (None, None, "assistant", None), (900, None, "user", "No turn."), (901, 0, "user", "word " * 100_000 + ".")]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)] + [(2000 + c, t, "user", "Same.") for c in range(80) for t in range(2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as kind", "3 as pos", "4 as cost", "5 as t1", "6 as block")
    assert got(repair(damage(turns), turns)) == brute(damaged(rows), [r[0] for r in rows])


def test_undamaged_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr("quillon.llm.repair.BLOCK", 5)
    monkeypatch.setattr(trie, "BLOCK", 5)
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    want = brute([(c, t, " " if q is None else q, " " if x is None else x) for c, t, q, x in rows], [r[0] for r in rows])
    assert got(repair(turns)) == want


def test_repeated_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi.")] * 3, "conv_id long, turn long, role string, text string")
    assert got(repair(turns)) == brute([(1, 0, "user", "Hi.")] * 3, [1])


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert got(repair(none)) == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(repair(none, spark.createDataFrame([(4,)], "conv_id long"))) == [(4, 0, 0, 0, 0, 0, 0, "", nothing)]
