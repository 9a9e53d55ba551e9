"""Connected components of a graph given as a table of edges, by alternating stars.

Every round replaces edges by edges to smaller neighbours. Nothing gathers a node's neighbours: the
smallest one is an aggregate, joined back, so a node of any degree is handled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.operators.order import materialize

_MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """From undirected edges (a, b) to (node, component), the smallest node reachable from each node.

    Nodes without an edge have no row. Loops and repeated edges have no effect.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = _state(current)
    for _ in range(_MOST_ROUNDS):
        if not before[0]:
            break
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a > b")
            .distinct()
        )
        current = materialize(small)
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    labelled = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labelled.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
