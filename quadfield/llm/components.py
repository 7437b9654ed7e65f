"""Connected components of an edge list by alternating large and small stars (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadfield.llm.common import staged

MAX_ROUNDS = 100


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; ``a`` < ``b`` in every edge."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    smaller = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return smaller.unionByName(own).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node of its component.

    Both steps keep the components and only shorten the way to the smallest node; the loop ends when every node hangs on its
    root directly.  Groups are reduced by partial aggregation, joins carry two numbers a row; edges may repeat, loops are ignored.
    """
    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()

    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = staged(edges)
    before = state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = staged(_small(staged(_large(edges).distinct())).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
