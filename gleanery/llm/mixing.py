"""Mixing sources to target weights by capped water-filling.  DataFrame functions only.

Every source has a weight.  The words of the whole corpus are shared by weight; a source whose share is above ``EPOCHS`` times
its words is clamped there, and what it can't take goes to the others by weight, until none is above.  A document is then taken as
many whole times as its source's target holds the source's words, and once more if it is among those that a
seeded hash picks to fill up the rest.

The picking needs no order over all documents of a source: hashes are counted in ``16 ** DIGITS`` bins per source; bins below
the cut are taken, the bin at the cut is counted again in as many finer bins, and of these the ones
whose middle lies below the cut.

Rules.  A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``; a null text has none.  Sources weigh 1, 2, 3, repeating, in the
order of their code points, a null source last.

Special cases.  A null source is a source.  Documents of no words are taken no words; a source without words has the target 0.  Rows with
one doc_id, or a null one, are told apart by their texts, and equal rows by numbers from 1 on, so that of many of them as many are picked as
of any others.  An empty table gives an empty result.  Other columns are carried along by ``mix`` in a
struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.llm.common import SMALL_ROWS, partitions
from gleanery.operators.skew import lookup_join
from gleanery.session import counted, write_out

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
DIGITS = 3  # hex digits of a level of bins


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``rank`` from 0 on, in code point order, null last, without a single task.

    A range of sources is numbered in each partition; the partitions' sizes give their first numbers.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = write_out(sources.withColumn("_none", order[0]).repartitionByRange(partitions(sources), "_none", "source")
                      .withColumn("_part", F.spark_partition_id()), "sources")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("_none", "source")) - 1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition.
    first = sizes.select("_part", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return own.join(first, "_part").withColumn("rank", F.col("_own") + F.col("_first")).drop("_part", "_own", "_first", "_none")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Each round is one aggregate over the sources.  The share per weight can only rise from round to round, so the
    clamped sources stay clamped, and the rounds end when no more are.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    held = write_out(ranked(sources).withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")), "sources")
    total = held.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        caps, free, now = held.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))),
                                   F.count(F.when(above, 1))).first()
        if now == clamped or not free:
            break
        level, clamped = (total - (caps or 0)) / free, now
    return held.select("source", "source_size", F.least(
        F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def cut(bins: DataFrame, keys: list[str], need: Column) -> DataFrame:
    """Per key: ``full``, the last bin that is needed, if only in part, and ``done``, the words below it.

    ``bins`` has the keys, bin, words; a window runs over the at most 16 ** DIGITS bins of a key.
    """
    by = Window.partitionBy(*keys).orderBy("bin")
    before = bins.withColumn("before", F.sum("words").over(by) - F.col("words"))
    last = before.where(F.col("before") < need).groupBy(*keys).agg(F.max_by(F.struct("bin", "before"), "bin").alias("at"))
    return last.select(*keys, F.col("at.bin").alias("full"), F.col("at.before").alias("done"))


def told_apart(sized: DataFrame) -> DataFrame:
    """``sized`` with hashes ``_h`` of which those that several rows share are told apart by a number.

    Equal rows are numbered within the parts in which they lie, on from the sizes of the parts before: none of them is
    moved to the others.
    """
    shared, n = counted(sized.groupBy("_h").count().where("count > 1").select("_h"), "shared")
    if not n:
        return sized
    few = F.broadcast(shared) if n <= SMALL_ROWS else shared
    dealt = write_out(sized.join(few, "_h", "left_semi").withColumn("_part", F.spark_partition_id()), "equal")
    sizes = dealt.groupBy("_h", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_h", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_h", "_part").orderBy("_s"))
    numbered = dealt.withColumn("_own", own).join(first, ["_h", "_part"])
    number = F.col("_own") + F.col("_first")
    apart = F.when(number > 1, F.md5(F.concat_ws(":", "_h", number.cast("string")))).otherwise(F.col("_h"))
    return sized.join(few, "_h", "left_anti").unionByName(numbered.withColumn("_h", apart).drop("_part", "_own", "_first"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
        seed: str = SEED) -> DataFrame:
    """Struct column ``row`` (the kept columns, all by default), size, source_size, target, times, taken."""
    keep = docs.columns if keep is None else keep
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.xxhash64("text").cast("string")))
    bin_at = lambda i: F.conv(F.substring("_h", i * DIGITS + 1, DIGITS), 16, 10).cast("int")
    hashed = write_out(
        docs.select(F.struct(*keep).alias("row"), F.col("source"), size_of().alias("size"), key.alias("_h"))
        .withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "hashed")
    sized = told_apart(hashed).select("row", "source", "_s", "size", bin_at(0).alias("_b0"), bin_at(1).alias("_b1"))
    cells = write_out(sized.groupBy("_s", "source", F.col("_b0").alias("bin")).agg(F.sum("size").alias("words")), "bins")
    goals = write_out(
        targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
        .withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).drop("source"), "targets")
    coarse = cut(cells.join(goals, "_s"), ["_s", "need"], F.col("need"))
    coarse = write_out(coarse, "cut")
    # The bin at the cut, counted again.
    at_cut = lookup_join(sized, coarse.select("_s", F.col("full").alias("_b0"), "need", "done"), ["_s", "_b0"], "inner", ["_b1"])
    finer = at_cut.groupBy("_s", "need", "done", F.col("_b1").alias("bin")).agg(F.sum("size").alias("words"))
    by = Window.partitionBy("_s").orderBy("bin")
    middle = F.col("done") + F.sum("words").over(by) - F.col("words") / 2
    fine = finer.withColumn("in", middle < F.col("need")).groupBy("_s").agg(
        F.coalesce(F.max(F.when(F.col("in"), F.col("bin"))), F.lit(-1)).alias("_fine"))
    plan = write_out(goals.join(coarse.select("_s", "full"), "_s", "left").join(fine, "_s", "left").select(
        "_s", "source_size", "target", "whole", F.coalesce("full", F.lit(-1)).alias("_full"),
        F.coalesce("_fine", F.lit(-1)).alias("_fine")), "plan")
    more = (F.col("_b0") < F.col("_full")) | (F.col("_b0") == F.col("_full")) & (F.col("_b1") <= F.col("_fine"))
    planned = lookup_join(sized, plan, ["_s"], "left", ["size", "_b0", "_b1"])
    times = (F.col("whole") + more.cast("int")).cast("long")
    return planned.select("row", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return mix(docs, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, in their columns, each as many times as the mix takes it."""
    return mix(docs, **options).where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
