"""Structure repair of conversations by a dynamic program over a prefix trie of signatures.

A signature has one sign a turn: its role's initial and its fault.  Sorted
signatures are the leaves of a prefix trie in order; a task walks its range of
them with the layers of the current branch on a stack, so what two signatures
share in front is computed once.  A layer holds, for each state of the grammar
(s?(ua)+)?, the least cost of reaching it and where its edits stand in ASCII
order among the states'.  Insertions belong to the next turn, so no edits of a
layer are a proper prefix of another's, and order now is order in the end.

Layers that differ by a constant cost only are one profile; there are few of them,
so a stack is an array of small numbers, and each step is worked out once.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import reliable, table
from quillon.llm.trie import BLOCK, numbered

#: Fixed values of the task: costs, and the roles that edits may give.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State after an inserted or re-roled turn.  States: start, after s, after u, after a.
GIVEN = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What is to be inserted in the end.
TAIL = ("", "II", "I", "")
#: Signs of a turn by role initial (s, u, a, other): sound, truncated, blank, duplicate.
SOUND, CUT, BLANK, AGAIN = "suao", "SUAO", "1234", "5678"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged by crc32(conv_id:turn) % 20, nulls one space: 0 no row, 1 no text, 2 no .!?, 3 twice, 4 from the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _keyed(turns: DataFrame) -> DataFrame:
    """conv (empty: null), turn, role, text, and two hashes of role and text; null roles and texts are one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.select("*", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal) of keyed turns.

    Texts stay where they are read.  A turn that repeats an earlier one is told
    by the first place of each (role, text); places are unique, so no key is
    large.  Signs are joined in blocks of turns, then the blocks of a
    conversation: a task holds one byte a turn of a conversation.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    at = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    fault = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    slim = numbered(rows.select("conv", "turn", "role", "t1", "t2", at.alias("at"), fault.alias("fault")))
    slim = reliable(slim.select("conv", "turn", "t1", "t2", "at", "fault", "pos"))
    first = slim.groupBy("conv", "t1", "t2").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    sign = lambda signs: F.substring(F.lit(signs), F.col("at"), F.lit(1))
    signs = F.when(F.col("fault") == 2, sign(BLANK)).when(F.col("first").isNull(), sign(AGAIN)).when(F.col("fault") == 1, sign(CUT)).otherwise(sign(SOUND))
    placed = slim.join(first, ["conv", "pos"], "left").select("conv", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", signs.alias("sign"))
    in_order = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "").alias("signature")
    blocks = placed.groupBy("conv", "block").agg(in_order("pos", "sign"))
    whole = blocks.groupBy("conv").agg(in_order("block", "signature"))
    turns = slim.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    n = F.length("signature")
    of = lambda signs: (n - F.length(F.translate("signature", signs, ""))).cast("long")
    roles = F.translate("signature", CUT + BLANK + AGAIN, SOUND * 3)
    legal = sum(((n - F.length(F.replace(roles, F.lit(pair)))) / 2).cast("long") for pair in ("su", "ua", "au"))
    return whole.join(turns, "conv").select("conv", "signature", "gaps", of(BLANK).alias("blank"), of(AGAIN).alias("duplicate"), of(CUT).alias("truncated"), (n - 1 - legal).cast("long").alias("illegal"))


class Layers:
    """Steps between profiles of layers, each worked out once.

    A profile has for each state None or (cost above the least, place in order).
    """

    def __init__(self):
        self.profiles = [((0, 0), None, None, None)]
        self.number = {self.profiles[0]: 0}
        self.steps: dict = {}

    def step(self, at: int, sign: str):
        """(next profile, least cost added, for each state (state before, edits))."""
        if (at, sign) not in self.steps:
            self.steps[at, sign] = self._step(self.profiles[at], sign)
        return self.steps[at, sign]

    def _step(self, layer, sign):
        dead, cut = sign in BLANK + AGAIN, TRUNCATED * (sign in CUT)
        found: list = [[], [], [], []]
        for before, entry in enumerate(layer):
            if entry is None:
                continue
            state = before
            for inserted in range(3):
                cost, edits = entry[0] + INSERT * inserted, "I" * inserted
                found[state].append((cost + DELETE, entry[1], edits + "D", before))
                if not dead:
                    found[GIVEN[state]].append((cost + REROLE + cut, entry[1], edits + "R", before))
                    if (kept := KEPT.get((state, sign.lower()))) is not None:
                        found[kept].append((cost + cut, entry[1], edits + "K", before))
                state = GIVEN[state]
        best = [min(x) if x else None for x in found]
        least = min(x[0] for x in best if x)
        order = sorted(x[1:3] for x in best if x)
        profile = tuple(x and (x[0] - least, order.index(x[1:3])) for x in best)
        if profile not in self.number:
            self.number[profile] = len(self.profiles)
            self.profiles.append(profile)
        return self.number[profile], least, [x and (x[3], x[2]) for x in best]

    def answer(self, stack, signature: str, cost: int) -> tuple[int, str]:
        """Cost and edits of a whole signature whose layers are on the stack."""
        extra, _, state = min((entry[0] + INSERT * len(TAIL[s]), entry[1], s) for s, entry in enumerate(self.profiles[stack[-1]]) if entry)
        edits = [TAIL[state]]
        for k in range(len(signature) - 1, -1, -1):
            state, now = self.steps[stack[k], signature[k]][2][state]
            edits.append(now)
        return cost + extra, "".join(reversed(edits))


def _walk(frames):
    layers, stack, costs, last, answer = Layers(), array("i", [0]), array("q", [0]), "", (0, "")
    for frame in frames:
        answers = []
        for signature in frame["signature"]:
            if signature != last:
                low, high = 0, min(len(last), len(signature))
                while low < high:  # how much both share in front
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if last[low:mid] == signature[low:mid] else (low, mid - 1)
                del stack[low + 1 :], costs[low + 1 :]
                for sign in signature[low:]:
                    at, more, _ = layers.step(stack[-1], sign)
                    stack.append(at)
                    costs.append(costs[-1] + more)
                last, answer = signature, layers.answer(stack, signature, costs[-1])
            answers.append(answer)
        yield frame.drop(columns="signature").assign(cost=[x[0] for x in answers], audit=[x[1] for x in answers])


def plans(known: DataFrame) -> DataFrame:
    """Signatures with cost and audit instead; ranges of (signature, conv), so that those that many share are split."""
    own = ", ".join(f"{c} long" for c in STATS)
    dealt = known.repartitionByRange("signature", "conv").sortWithinPartitions("signature", "conv")
    return dealt.mapInPandas(_walk, f"conv string, {own}, cost long, audit string")


def _apply(frames):
    """Header rows carry a conversation's audit; its turns follow in order."""
    head, digest, audit, at, state, some = None, None, "", 0, 0, False

    def put(role, text):
        nonlocal some
        digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
        some = True

    def inserts():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            put(("user", "assistant")[state == 2], "")
            state, at = GIVEN[state], at + 1

    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            if row["kind"] == 0:
                if head:
                    inserts()
                    out.append(head | {"repaired_sha256": digest.hexdigest()})
                head, digest, audit, at, state, some = row, hashlib.sha256(), row["text"], 0, 0, False
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "R":
                put(("user", "assistant")[state == 2], row["text"])
                state = GIVEN[state]
            elif edit == "K":
                put(row["role"], row["text"])
                state = KEPT[state, row["role"][0]]
        yield _done(out)
    if head:
        inserts()
        yield _done([head | {"repaired_sha256": digest.hexdigest()}])


def _done(rows):
    return pd.DataFrame(rows, columns=["conv", *STATS, "cost", "text", "repaired_sha256"]).rename(columns={"text": "audit"})


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation.

    ``turns``: (conv_id, turn, role, text), other columns are not read; ``ids``:
    (conv_id) of conversations to return, those of ``turns`` without it.
    Turns are ordered by turn, null first; equal ones by role and a hash of role
    and text.  Null roles and texts are one space; rows without conv_id are one
    conversation of a null id.  A conversation without turns has zeros, an empty
    audit and the hash of nothing.  Returns (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256).

    A repaired text is hashed in order, so all turns of a conversation pass
    through one task; it reads them from sorted files and holds one batch.
    """
    rows = _keyed(turns)
    kind = (turns if ids is None else ids).schema["conv_id"].dataType
    every = (turns if ids is None else ids).select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    zero = F.lit(0).cast("long")
    known = every.join(signatures(rows), "conv", "left").select("conv", F.coalesce("signature", F.lit("")).alias("signature"), *[F.coalesce(c, zero).cast("long").alias(c) for c in STATS])
    heads = plans(known).select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), zero.alias("t1"), zero.alias("t2"), *STATS, "cost")
    body = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "t1", "t2", *[zero.alias(c) for c in [*STATS, "cost"]])
    dealt = heads.unionAll(body).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "t1", "t2")
    own = ", ".join(f"{c} long" for c in [*STATS, "cost"])
    out = dealt.select("conv", "kind", "role", "text", *STATS, "cost").mapInPandas(_apply, f"conv string, {own}, audit string, repaired_sha256 string")
    return out.select(F.nullif("conv", F.lit("")).cast(kind).alias("conv_id"), *STATS, "cost", "audit", "repaired_sha256")


def op13_structure_repair(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair(damage(turns), turns.select("conv_id"))
