"""Connected components of an edge table, by alternating star contraction.

Each round links every node's neighbours to its smallest neighbour, first the
larger ones (large star), then the smaller ones (small star); rounds grow
with the logarithm of the number of nodes. Minima are partial aggregates, so
a hub costs no task its whole neighbourhood; joins broadcast the minima of few
edges, and are else plain equi-joins that adaptive execution splits where a hub
is hot. Beyond such broadcasts edges never leave the executors; each round is
cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut

#: Edges whose minima may be a broadcast: 16 bytes each, 8 MB at most.
BROADCAST_ROWS = 500_000


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = F.broadcast(least) if few else cut(least)
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least if few else cut(least)
    joined = edges.join(F.broadcast(least) if few else least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another: root is the
    smallest node that it reaches. Edges with a null end and loops count for
    nothing; an empty table gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    e = cut(e.filter(e[2] & (F.col("u") != F.col("v"))).select("u", "v").distinct())
    mark = _mark(e)
    while mark[0]:
        few = mark[0] <= BROADCAST_ROWS
        larger = _large_star(e, few)
        e = cut(_small_star(larger if few else cut(larger), few).distinct())
        if (new := _mark(e)) == mark:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
