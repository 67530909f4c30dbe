"""Reply trees as training conversations: paths from the root to each leaf, ranked, formatted, with a loss mask.

Paths come from iterative self-joins: the k-th joins the table of ancestors at
distance 2^k with itself, so there are as many as the depth has binary digits;
as many more unfold each leaf into its ancestors, one per binary digit of their
distance.  Everything is DataFrame functions.

The template marks a turn by ``<turn role="..">``, a line break, the text and
``</turn>``, a line break.  Inside roles and texts the signs that its marks are
made of are escaped: a backslash becomes \\s, < becomes \\l, > becomes \\g, so no
text can open or close a turn, and reading back needs no context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import reliable, table
from quillon.llm.trie import numbered

#: Fixed values of the template.
OPEN, HEAD_END, CLOSE = '<turn role="', '">\n', "</turn>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))


def escape(c: Column) -> Column:
    for plain, escaped in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def unescape(c: Column) -> Column:
    """The inverse: every backslash has its letter, so the order of replacing is free but for the backslash itself, the last."""
    for plain, escaped in reversed(ESCAPES):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def reply_paths(replies: DataFrame) -> DataFrame:
    """(tree, leaf, node, up, length): every node of every path from a root to a leaf, ``up`` steps above the leaf.

    ``replies``: (tree, node, parent).  A node without parent, or whose parent is
    not in its tree, is a root.  Repeated rows count once.  Nodes on a cycle of
    parents, or below one, have no root and no path.
    """
    nodes = reliable(replies.select("tree", "node", "parent").distinct())
    names = nodes.select("tree", "node").distinct()
    jump = reliable(nodes.join(names.withColumnRenamed("node", "parent"), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")))
    paths = names.join(jump.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jumps, most = [], names.count()
    while not jump.isEmpty():
        if 1 << len(jumps) >= most:  # so far above is only who goes round in a circle
            paths = paths.join(jump.select("tree", F.col("node").alias("leaf")).distinct(), ["tree", "leaf"], "left_anti")
            break
        jumps.append(jump)
        again = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("far"))
        jump = reliable(jump.join(again, ["tree", "to"]).select("tree", "node", F.col("far").alias("to")))
    for k in range(len(jumps) - 1, -1, -1):
        both = paths.join(jumps[k], ["tree", "node"], "left")
        step = F.array(F.struct("node", "up"), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))))
        paths = both.select("tree", "leaf", F.explode(F.filter(step, lambda x: x.isNotNull())).alias("at")).select("tree", "leaf", "at.node", "at.up")
    return paths


def ranked_paths(replies: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, node, up) of the ``keep`` best paths of each tree, of all without it.

    ``replies``: (tree, node, parent, score).  A path's score is the mean of its
    nodes', null counting as 0; rank 1 is the highest, then the longest, then the
    smallest leaf.
    """
    paths = reliable(reply_paths(replies))
    if keep is None and "score" not in replies.columns:
        return paths.withColumn("rank", F.lit(None).cast("int"))
    scores = replies.groupBy("tree", "node").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    branches = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    best = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")))
    best = best if keep is None else best.where(F.col("rank") <= keep)
    return paths.join(best.select("tree", "leaf", "rank"), ["tree", "leaf"])


def format_paths(paths: DataFrame, texts: DataFrame, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, loss_mask) of (tree, leaf, node, up) and (tree, node, role, text), in the order from the root.

    ``loss_mask``: for each turn of the trained role, in order, where its escaped
    text is: (turn, from 0; skip, characters of the turn before it; start, the
    same from the beginning of all; length), in code points.  Null roles and
    texts are empty.  A node that has several rows is said as often, one after
    the other, by role and text.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(HEAD_END))
    rows = texts.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), text.alias("text"))
    said = paths.select("tree", "leaf", "node", "up").join(rows, ["tree", "node"])
    size = (F.length("head") + F.length("text") + len(CLOSE)).cast("long")
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))
    turn = F.struct("start", F.length("head").alias("skip"), F.length("text").alias("length"), (F.col("role") == trained).alias("trained"), F.concat("head", "text", F.lit(CLOSE)).alias("piece"))
    whole = said.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform("turns", lambda x, i: F.when(x["trained"], F.struct(i.alias("turn"), x["skip"].alias("skip"), (x["start"] + x["skip"]).alias("start"), x["length"].alias("length"))))
    return whole.select("tree", "leaf", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), F.filter(mask, lambda x: x.isNotNull()).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""

    def turn(piece):
        head = F.substring_index(piece, HEAD_END, 1)
        return F.struct(unescape(F.substring(head, len(OPEN) + 1, F.length(head))).alias("role"), unescape(F.substring(piece, F.length(head) + len(HEAD_END) + 1, F.length(piece))).alias("text"))

    pieces = F.split(formatted, CLOSE)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    pieces = F.split(formatted, CLOSE)
    return F.array_join(F.transform(mask, lambda x: unescape(F.substring(pieces[x["turn"]], x["skip"] + 1, x["length"]))), "")


def threads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies (tree, node, parent) and texts (tree, node, role, text) of linear conversations (conv_id, turn, role, text).

    Each turn replies to the one before it: by turn, null first; equal ones by
    role and a hash of role and text.  Equal rows are one node, said as often.
    A null conv_id is a tree of its own, the empty name.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"))
    node = F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.hex("t1"), F.hex("t2"))
    places = reliable(numbered(rows.select("conv", "turn", "role", "t1", "t2").distinct()).select("conv", "pos", node.alias("node")))
    before = places.select("conv", (F.col("pos") + 1).alias("pos"), F.col("node").alias("parent"))
    replies = places.join(before, ["conv", "pos"], "left").select(F.col("conv").alias("tree"), "node", "parent")
    return replies, rows.select(F.col("conv").alias("tree"), node.alias("node"), "role", "text")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of a table (conv_id, turn, role, text), see :func:`threads` and :func:`format_paths`; other columns are not read."""
    replies, texts = threads(turns)
    done = format_paths(ranked_paths(replies), texts)
    return done.select(F.nullif("tree", F.lit("")).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "formatted", "loss_mask")


def op12_chat_formatting(spark, sf_dir) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*more.columns).unionAll(more)
    read = format_conversations(turns).select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
