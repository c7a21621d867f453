"""Joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.session import size_of

# A key is hot from this many rows on; every HOT_ROWS of it form one share.
HOT_ROWS = 100_000
# Bounds of the table of hot keys, which is broadcast: 65,536 rows of 12 bytes.
# A key outside the first 65,536 holds less than that part of all rows, which is no more than a task's fair share.
MAX_HOT_KEYS = 1 << 16
MAX_SHARES = 4096
# A table is broadcast only if a check finds it within these bounds.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 32 << 20


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key hash, number of shares) of the heaviest keys of ``df``."""
    return (
        df.groupBy(F.xxhash64(*on).alias("_key"))
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"))
        .limit(MAX_HOT_KEYS)
        .select("_key", F.least(F.ceil(F.col("_rows") / hot_rows), F.lit(MAX_SHARES)).cast("int").alias("_shares"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Equi join on ``on`` whose hot left keys are split into shares.

    Rows of a hot key are spread by a hash of ``spread_by`` (their identity);
    the matching right rows are repeated once per share.  Every left row meets
    every right row of its key exactly once, so any join type that keeps or
    tests left rows gives the result of the plain join.  ``rows`` is the number
    of left rows where it is known; too few rows have no hot key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    if rows is not None and rows <= hot_rows:
        return left.join(right, list(on), how)
    hot = F.broadcast(hot_keys(left, on, hot_rows))
    shared = left.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left")
    salt = F.when(F.col("_shares").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("_shares"))).otherwise(F.lit(0))
    shared = shared.withColumn("_salt", salt.cast("int")).drop("_key", "_shares")
    every = F.when(F.col("_shares").isNotNull(), F.sequence(F.lit(0), F.col("_shares") - 1)).otherwise(
        F.array(F.lit(0)))
    repeated = (
        right.withColumn("_key", F.xxhash64(*on))
        .join(hot, "_key", "left")
        .withColumn("_salt", F.explode(every))
        .drop("_key", "_shares")
    )
    return shared.join(repeated, [*on, "_salt"], how).drop("_salt")


# Nodes of a plan that give no more rows than they get.
NARROWING = {"Project", "Filter", "Distinct", "Deduplicate", "Aggregate", "SubqueryAlias", "Sort", "GlobalLimit", "LocalLimit"}


def most(df: DataFrame) -> tuple[int, int] | None:
    """(rows, bytes) that a table has at most, where that follows from the written tables it selects from."""
    def of(plan) -> tuple[int, int] | None:
        kind = plan.nodeName()
        if kind.startswith("Relation") or kind == "LogicalRelation":
            paths = plan.relation().location().rootPaths()
            size = size_of(paths.head().toString()) if paths.size() == 1 else None
            return size if size and size[1] is not None else None
        parts = [of(plan.children().apply(i)) for i in range(plan.children().size())]
        if kind == "Union" and all(parts):
            return sum(p[0] for p in parts), sum(p[1] for p in parts)
        keeps_left = kind == "Join" and plan.joinType().toString() in ("LeftSemi", "LeftAnti")
        return parts[0] if kind in NARROWING or keeps_left else None

    try:
        return of(df._jdf.queryExecution().analyzed())
    except Py4JError:  # a leaf of another kind
        return None


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to broadcast; reads no more than the bound, and nothing where the sizes of written tables tell."""
    bound = most(df)
    if bound and bound[0] <= max_rows and 4 * bound[1] <= max_bytes:  # a selected text may be joined of several
        return True
    sizes = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes")).take(max_rows + 1)
    return len(sizes) <= max_rows and sum(s["bytes"] for s in sizes) <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
) -> DataFrame:
    """Join with a stored table or list: broadcast after a check, else salted."""
    if is_small(right):
        return left.join(F.broadcast(right), list(on), how)
    return salted_join(left, right, on, how, spread_by)


def relevant(stored: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stored rows whose key occurs in a batch.

    The keys of a small batch are broadcast, so that the stored table is only
    scanned, not shuffled.  For a large batch the table is returned as it is:
    the join that follows does the same work once.
    """
    keys = batch.select(*on).distinct()
    return stored.join(F.broadcast(keys), list(on), "left_semi") if is_small(keys) else stored


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key, the first in ``order``.

    The filter on the row number reaches below the shuffle, so each task sends
    at most one row per key.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")
