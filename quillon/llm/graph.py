"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import reliable


def _settled(links: DataFrame) -> bool:
    """Whether links (u, v) are stars: no target is itself a source, and nothing has two targets."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(links.select(F.col("v").alias("node"), F.lit(0), F.lit(1)))
    at = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not at.where("out > 1 or (out = 1 and into = 1)").limit(1).count()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: two columns u, v of one type.  Alternates the large-star and
    small-star contractions (Kiveris et al., 2014): every node links to the
    smallest of its neighbours, until the links form stars.  A round costs two
    shuffles of the remaining edges and is checkpointed; the number of rounds
    grows with the logarithm of the longest path, and is none where the edges
    are stars around smallest nodes.  Returns (node, component).
    """
    links = reliable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if _settled(links):
            break
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        links = reliable(small)
    else:
        raise RuntimeError("components did not settle; raise rounds")
    own = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)
