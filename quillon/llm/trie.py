"""Prefix tries of conversations, their subtree totals by leaf-peeling message passing.

A node is a sequence of first turns.  Its key is the exclusive or of hashes of
(position, role, text), 2 x 64 bits, so keys of all prefixes are running values
over positions, which blocks of a conversation give side by side: no
conversation, however long, has to be in one task.

Nodes that are peeled one by one would need as many rounds as a conversation has
turns.  So the nodes that share the member of the largest hash, which always form
one path downwards, are peeled together: such a path holds a counter of the paths
that still hang on it, and a path whose counter is zero sends its total to the
path above.  Whatever the trie, a way from the root to a leaf changes to another
member of largest hash about log n times, so there are some log n rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import reliable, table

#: Turns of a conversation, or nodes of a path, over which running values are taken at once.
BLOCK = 4096
#: Bytes of a piece of a list of members.
PIECE = 1 << 16
NODE = ["depth", "k1", "k2"]


def slim_turns(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, t1, t2, chars): two hashes of role and text instead of the text; null roles and texts are empty, rows without conv_id go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("chars"))


def numbered(rows: DataFrame) -> DataFrame:
    """Slim turns with ``pos`` from 1 in each conv: by turn, null first, then role and hashes.

    Ranges of the order are numbered by themselves; what a conversation has in
    earlier ranges is added, which concerns one conversation a range.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]
    dealt = reliable(rows.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).where("before > 0").drop("n")
    local = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    joined = local.join(F.broadcast(before), ["conv", "part"], "left")  # at most a row for each partition
    return joined.select(*rows.columns, (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"))


def with_heads_of(rows: DataFrame, ids: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Numbered turns after each conversation's first h turns became those of conversation c - c % every; h is crc32(c) % most."""
    own_h = lambda c: F.crc32(F.col(c).cast("string")) % most
    heads = rows.where(F.col("conv") % every == 0).where(F.col("pos") < most)
    want = ids.select("conv", (F.col("conv") - F.col("conv") % every).alias("of"), own_h("conv").alias("h")).where("h > 0")
    taken = want.join(heads.withColumnRenamed("conv", "of"), "of").where("pos <= h").select("conv", "pos", "t1", "t2", "chars")
    # where the other conversation has fewer than h turns, the own ones move up
    lengths = heads.groupBy(F.col("conv").alias("of")).agg(F.max("pos").alias("has"))
    short = want.join(lengths, "of", "left").select("conv", (F.col("h") - F.coalesce("has", F.lit(0))).alias("up")).where("up > 0")
    rest = rows.where(F.col("pos") > own_h("conv")).join(short, "conv", "left").select("conv", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "t1", "t2", "chars")
    return taken.unionAll(rest)


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars): the node after each turn and the one before it."""
    rows = rows.select("conv", F.col("pos").alias("depth"), "chars", F.xxhash64("pos", "t1", "t2").alias("h1"), F.xxhash64("t2", "pos", "t1", F.lit(1)).alias("h2"), F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    rows = reliable(rows)
    inner = Window.partitionBy("conv", "block").orderBy("depth")
    outer = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    blocks = blocks.select("conv", "block", F.bit_xor("h1").over(outer).alias("b1"), F.bit_xor("h2").over(outer).alias("b2")).where("block > 0")
    run = rows.select("*", F.bit_xor("h1").over(inner).alias("r1"), F.bit_xor("h2").over(inner).alias("r2")).join(blocks, ["conv", "block"], "left")
    key = [F.col(f"r{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)]
    return run.select("conv", "depth", "chars", *[key[k - 1].alias(f"k{k}") for k in (1, 2)], *[key[k - 1].bitwiseXOR(F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2)])


def _nodes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node: key, parent's key, smallest member, member of largest hash (``path``), members, children, weight."""
    member = [F.min("conv").alias("conv_id"), F.max(F.struct(F.xxhash64("conv", F.lit(7)), "conv"))["conv"].alias("path"), F.count("*").alias("n_convs")]
    deep = rows.groupBy(*NODE).agg(*member, F.first("chars").alias("chars"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    root = ids.agg(*member).where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", "path", "n_convs", F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    both = reliable(deep.select(F.col("depth").cast("long").alias("depth"), *root.columns[1:]).unionAll(root))
    children = both.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = both.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    joined = both.join(children, NODE, "left").join(above, ["depth", "p1", "p2"], "left")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    return reliable(joined.select(*NODE, "conv_id", "parent_conv_id", "path", "up", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))


def _peel(nodes: DataFrame) -> DataFrame:
    """(path, depth, leaves, saved): what the finished paths that hang on a node have sent to it.

    Each round all paths that wait for no other send their totals up and are
    done; the last is that of the root.  Only the paths still waiting are looked at.
    """
    top = F.struct("depth", "up")
    paths = nodes.groupBy("path").agg(F.min(F.when(F.col("up").isNull() | (F.col("up") != F.col("path")), top)).alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    paths = paths.select("path", F.col("top.up").alias("up"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved")
    hanging = paths.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("waiting"))
    waiting = reliable(paths.join(hanging, "path", "left").select(*paths.columns, F.coalesce("waiting", F.lit(0)).alias("waiting")))
    sent = []
    while True:
        done = waiting.where("waiting = 0 and up is not null").select(F.col("up").alias("path"), F.col("at").alias("depth"), "leaves", "saved")
        sent.append(done)
        told = done.groupBy("path").agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        left = waiting.where("waiting > 0").join(told, "path", "left")
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        waiting = reliable(left.select("path", "up", "at", more("leaves", "l"), more("saved", "s"), (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting")))
        if waiting.isEmpty():
            break
    out = sent[0]
    for x in sent[1:]:
        out = out.unionAll(x)
    return out.groupBy("path", "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes with leaves and saved summed over their subtrees: own weights, received totals, and those of all nodes below on the path."""
    told = nodes.join(_peel(nodes), ["path", "depth"], "left")
    told = told.withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0)), "block": F.floor(F.col("depth") / BLOCK)}).drop("l", "s")
    told = reliable(told)
    inner = Window.partitionBy("path", "block").orderBy(F.col("depth").desc())
    outer = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = told.groupBy("path", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    blocks = blocks.select("path", "block", F.sum("l").over(outer).alias("l"), F.sum("s").over(outer).alias("s")).where("l is not null")
    told = told.withColumns({"leaves": F.sum("leaves").over(inner), "saved": F.sum("saved").over(inner)}).join(blocks, ["path", "block"], "left")
    return told.withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})


def _runs(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """Bounds of the runs of equal nodes in sorted rows."""
    keys = frame[NODE].to_numpy()
    cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(keys)]))


def member_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, digest) of (depth, k1, k2, conv): SHA-256 of the ids of each node, ascending, comma-joined.

    Ranges of (node, id) write their ids as pieces of text; only pieces meet at
    a node, and they are read in order, one at a time.
    """

    def write(frames):
        for frame in frames:
            ids, at, pieces = frame["conv"].to_numpy(), [], []
            for a, b in _runs(frame) if len(frame) else []:
                for x in range(a, b, PIECE // 20):
                    at.append(x)
                    pieces.append(",".join(map(str, ids[x : min(b, x + PIECE // 20)].tolist())))
            yield frame.iloc[at].assign(piece=pd.Series(pieces, index=frame.index[at], dtype=object))

    def digest(frames):
        key, held = None, None
        for frame in frames:
            done = []
            for *now, piece in frame[[*NODE, "piece"]].itertuples(index=False):
                if now == key:
                    held.update(b",")
                else:
                    if key:
                        done.append((*key, held.hexdigest()))
                    key, held = now, hashlib.sha256()
                held.update(piece.encode())
            yield pd.DataFrame(done, columns=[*NODE, "digest"])
        if key:
            yield pd.DataFrame([(*key, held.hexdigest())], columns=[*NODE, "digest"])

    node = "depth long, k1 long, k2 long"
    pieces = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInPandas(write, f"{node}, conv long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv").mapInPandas(digest, f"{node}, digest string")


def prefix_trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations.

    ``rows``: (conv, pos, t1, t2, chars), positions from 1 without gaps (see
    :func:`slim_turns`, :func:`numbered`); ``ids``: distinct ``conv`` of all
    conversations, those without turns too.  Returns (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256);
    a node is named by its smallest member and depth.  No conversations: no
    nodes.  Only turnless ones: the root alone, which is then a leaf.
    """
    steps = reliable(_prefixes(rows))
    nodes = _nodes(steps, ids)
    last = steps.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("end"))
    zero = F.lit(0).cast("long")
    ends = ids.join(last, "conv", "left").select("conv", *[F.coalesce(F.col("end")[c], zero).cast("long").alias(c) for c in NODE])
    out = _subtrees(nodes).join(member_digests(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, rebuild: bool = False) -> DataFrame:
    """:func:`prefix_trie` of a table (conv_id, turn, role, text); other columns are not read.

    Turns are ordered by turn, null first; equal ones by role and a hash of role
    and text, so repeated rows are turns of their own.  Null roles and texts are
    empty; rows without conv_id belong to no conversation.  ``rebuild``: see
    :func:`with_heads_of`.  Texts are hashed where they are read and travel no
    further, so their length does not matter.
    """
    rows = reliable(numbered(slim_turns(turns)).select("conv", "pos", "t1", "t2", "chars"))
    ids = reliable(rows.select("conv").distinct())
    return prefix_trie(with_heads_of(rows, ids) if rebuild else rows, ids)


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)
