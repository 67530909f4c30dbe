import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat

SAID = "\\### Assistant: </turn> ok"
TEXTS = [SAID, "", None, 'a" <turn role="user">\nb', "\\s \\\\l < > é", "</turn>\n", "plain\n\ntext"]


def shown(turns):
    """Formatted text and spans, written plainly."""
    out, spans = "", []
    for role, text in turns:
        clean = lambda s: "".join({"\\": "\\s", "<": "\\l", ">": "\\g"}.get(c, c) for c in s)
        out += f'<turn role="{clean(role)}">\n'
        if role == "assistant":
            spans.append((len(out), len(clean(text))))
        out += clean(text) + "</turn>\n"
    return out, spans


def test_conversations_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 3, 9, 33])):
            rows.append((c, t if t else rng.choice([None, 0]), rng.choice(["user", "assistant", "system", None, 'x">\n']), rng.choice(TEXTS)))
    rows += [(None, 0, "assistant", "nobody's"), (70, 0, "assistant", "word " * 200_000), (71, 4, "user", "same"), (71, 4, "user", "same"), (71, 4, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tree", "2 as node", "3 as up", "4 as formatted", "5 as start")
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = chat.format_conversations(turns).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(got) == len(want)
    for r in got:
        own = want[r["conv_id"]]
        text, spans = shown(own)
        assert r["formatted"] == text and [(s["start"], s["length"]) for s in r["loss_mask"]] == spans
        assert [tuple(t) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")


def plain_paths(edges):
    parent = {n: p for n, p in edges}
    leaves = set(parent) - set(parent.values())
    out = {}
    for leaf in leaves:
        path, at = [], leaf
        while at in parent and len(path) <= len(parent):
            path.append(at)
            at = parent[at]
        if len(path) <= len(parent):
            out[leaf] = path[::-1]
    return out


@pytest.mark.parametrize("n", [1, 2, 40, 200])
def test_paths_of_trees(spark, n):
    rng = random.Random(n)
    edges = [(k, rng.choice([None, 10**6]) if k == 0 else max(0, k - rng.choice([1, 1, 1, 2, 7]))) for k in range(n)]
    edges += [(1000, 1001), (1001, 1000), (1002, 1001)]  # a circle and who hangs on it
    want = plain_paths(edges)
    df = spark.createDataFrame([(1, a, b) for a, b in edges] + [(2, 5, None), (2, 5, None)], "tree int, node int, parent int")
    got = {}
    for r in sorted(chat.reply_paths(df).collect(), key=lambda r: -r["up"]):
        got.setdefault((r["tree"], r["leaf"]), []).append(r["node"])
    assert got == {(1, leaf): path for leaf, path in want.items()} | {(2, 5): [5]}


def test_ranks_and_formats_branches(spark):
    rows = [("t", "a", None, 1.0, "user", "q"), ("t", "b", "a", 0.2, "assistant", "bad"), ("t", "c", "a", 0.9, "assistant", "good"), ("t", "d", "a", None, "assistant", "none"), ("u", "a", "gone", None, "user", "alone")]
    replies = spark.createDataFrame(rows, "tree string, node string, parent string, score double, role string, text string")
    ranks = {(r["tree"], r["leaf"]): r["rank"] for r in chat.ranked_paths(replies).collect()}
    assert ranks == {("t", "c"): 1, ("t", "b"): 2, ("t", "d"): 3, ("u", "a"): 1}
    best = chat.ranked_paths(replies, keep=1)
    got = {r["tree"]: r["formatted"] for r in chat.format_paths(best, replies).collect()}
    assert got == {"t": shown([("user", "q"), ("assistant", "good")])[0], "u": shown([("user", "alone")])[0]}


def test_nothing_to_format(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(turns).collect() == []


def test_query_against_its_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    want = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in sorted({r[0] for r in rows}):
        own = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        loss = "".join(t for r, t in own if r == "assistant")
        want.append((c, len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), len(shown(own)[0])))
    assert sorted(tuple(r) for r in chat.op12_chat_formatting(spark, d).collect()) == want
