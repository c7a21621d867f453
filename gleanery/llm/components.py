"""Connected components of a graph given by its edges, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.llm.common import partitions, spread_fetch
from gleanery.session import counted, write_out


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node that can be reached) of the nodes of ``edges`` (a, b: longs).

    Every node has a parent, at first itself.  In each round the nodes take over the least grandparent
    among their neighbours', their parents too, and halve their own way to the root.  The rounds end when no grandparent
    changes; they grow with the logarithm of the longest chain.  Joins on parents and on hubs are dealt out, minima are taken below
    the shuffle, and each round is a written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    both = write_out(both, "edges")
    state, left = counted(both.select(F.col("a").alias("node"), F.col("a").alias("parent"), F.col("a").alias("grand")).distinct(), "parents")
    salts = partitions(edges)
    while left:
        # The least grandparent among the neighbours.
        near = spread_fetch(both, "b", "a", state.select(F.col("node").alias("b"), F.col("grand").alias("up")), salts)
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("up").alias("least"))
        met = state.join(least, "node")
        parents = (met.select(F.explode(F.array(
            F.struct(F.col("parent").alias("node"), F.col("least").alias("parent")),
            F.struct(F.col("node"), F.least("least", "grand").alias("parent")))).alias("x"))
            .groupBy("x.node").agg(F.min("x.parent").alias("parent")))
        now = write_out(state.select("node", F.col("parent").alias("_old"), F.col("grand").alias("_grand"))
                        .join(parents, "node").select("node", F.least("parent", "_old").alias("parent"), "_grand"), "parents")
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        state, _ = counted(spread_fetch(now, "parent", "node", up, salts), "parents")
        left = state.where("grand != _grand").limit(1).count()
        state = state.select("node", "parent", "grand")
    return state.select("node", F.col("grand").alias("component"))
