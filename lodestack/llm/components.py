"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round replaces the edges of a node by edges to its smallest neighbour; rounds end when every node hangs on one that hangs on
none, which a further round would leave as it is (such edges are not written once more to see that they repeat). The rounds grow with the logarithm of the longest chain. Every round is written to the shared folder, so lost executors cost
one round. A round aggregates before it joins, so a hub costs no more than its edges and its join can be split. The large star
is written before the small one reads it: the small one names its edges three times, and a plan that held the large star as often
would be planned anew in the driver after every shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, merged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small: a > b for every edge; the neighbours of a are the b's. large: every neighbour.
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    joined = merged(both, least, "a")
    if small:
        out = joined.select(F.col("b").alias("v"), "m").unionByName(least.select(F.col("a").alias("v"), "m"))
    else:
        out = joined.where("b > a").select(F.col("b").alias("v"), "m")
    return out.where("v <> m").distinct().select(F.col("v").alias("a"), F.col("m").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether no node of the distinct edges (a, b), a > b, hangs on two others or on one that hangs on another."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_nodes = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0")
    return not open_nodes.agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b bigint, no nulls) that is not itself the smallest of its component."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        now = cut(_star(cut(_star(now, small=False), "stars"), small=True), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
