"""Chains of pages: following next-page links without a loop over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from gleanery.operators.skew import salted_join
from gleanery.session import write_out


def walk(seeds: DataFrame, edges: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(seed, node, step) of every page reached from a seed by next links.

    ``seeds`` (seed, node), ``edges`` (node, next).  A page counts at its first visit.
    """
    starts = seeds.select(F.col("seed").alias("group"), "node", F.lit(0).alias("rank"))
    return first_reach(starts, edges, max_steps).select(F.col("group").alias("seed"), "node", "step")


def first_reach(starts: DataFrame, edges: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(group, node, rank, step): the start of least rank, of all starts of a group, that gets to a page, and its distance.

    ``starts`` (group, node, rank), ``edges`` (node, next).  Each round doubles the
    distance covered: all that was reached jumps ahead by the span so far, so
    a chain of n pages takes log2(n) rounds.  A page keeps its least (rank, step) only, so that the rows of a group are never
    more than the pages it reaches, however many starts lie on a chain and in whatever order.  A round that changes
    nothing ends the walk, loops included.
    """
    start = starts.groupBy("group", "node").agg(F.min("rank").alias("rank")).withColumn("step", F.lit(0).cast("bigint"))
    single = edges.where("next is not null").groupBy("node").agg(F.min("next").alias("next"))
    reached, jumps, count, _, links = _written(start.withColumn("changed", F.lit(True)), single)
    span = 1
    while links and (max_steps is None or span <= max_steps):
        ahead = salted_join(reached, jumps, ["node"], "inner", ["group"], rows=count).select(
            "group", F.col("next").alias("node"), F.struct("rank", (F.col("step") + span).alias("step")).alias("at"))
        if max_steps is not None:
            ahead = ahead.where(F.col("at.step") <= max_steps)
        so_far = reached.select("group", "node", F.struct("rank", "step").alias("at"), F.lit(True).alias("old"))
        best = so_far.unionByName(ahead.withColumn("old", F.lit(False))).groupBy("group", "node").agg(
            F.min("at").alias("at"), F.min(F.when(F.col("old"), F.col("at"))).alias("before"))
        best = best.select("group", "node", "at.*", (F.col("before").isNull() | (F.col("at") < F.col("before"))).alias("changed"))
        onward = jumps.select(F.col("node").alias("next"), F.col("next").alias("_onward"))
        twice = salted_join(jumps, onward, ["next"], "inner", ["node"], rows=links).select(
            "node", F.col("_onward").alias("next"))
        reached, jumps, count, changed, links = _written(best, twice)
        if not changed:
            break
        span *= 2
    return reached


def _written(reached: DataFrame, jumps: DataFrame) -> tuple[DataFrame, DataFrame, int, int, int]:
    """Write both tables of a round in one job; also gives their row counts and that of changes."""
    state = reached.withColumn("kind", F.lit("reached")).unionByName(
        jumps.withColumn("kind", F.lit("jump")), allowMissingColumns=True)
    is_reached = F.col("kind") == "reached"
    seen = Observation()
    state = state.observe(seen, F.count_if(is_reached).alias("reached"), F.count_if("changed").alias("changed"),
                          F.count_if(~is_reached).alias("jumps"))
    written = write_out(state, "walk", partition_by=["kind"])
    return (written.where(is_reached).select("group", "node", "rank", "step"), written.where(~is_reached).select("node", "next"),
            seen.get["reached"], seen.get["changed"], seen.get["jumps"])


def stitch(parts: DataFrame, group: list[str]) -> DataFrame:
    """Parts (group, step, text) joined to one text per chain, in step order."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "text")))
    return (
        parts.groupBy(*group)
        .agg(ordered.alias("_parts"))
        .select(*group, F.size("_parts").cast("bigint").alias("parts"),
                F.array_join(F.col("_parts.text"), "").alias("content"))
    )


def own_or_linked(pages: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Text of the linked page where there is one, else the page's own."""
    other = linked.select(key, F.col("html").alias("_linked"))
    joined = salted_join(pages, other, [key], "left", [key])
    return joined.withColumn("html", F.coalesce("_linked", "html")).drop("_linked")
