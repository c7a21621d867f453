"""Rows that a step cannot use are set aside with a reason, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.fixed_values import MAX_TRIES
from gleanery.schemas import too_long, with_defaults


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows without and with a reason, which stays on the bad ones."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def fitting(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split off the rows whose text is too long for a table."""
    return split(df, too_long(df, table))


def as_quarantine(bad: DataFrame, step: str, attempts: int = 1) -> DataFrame:
    return with_defaults(bad, "quarantine", {"step": step, "attempts": attempts})


LEDGER_KEY = ["step", "rule", "url"]


def merge_ledger(stored: DataFrame, failed: DataFrame, found: DataFrame, max_tries: int = MAX_TRIES) -> DataFrame:
    """Ledger entries (step, rule, url, attempts, state) that a pass adds or changes.

    ``stored``: the newest entry of each key; ``failed`` (step, rule, url): what was tried and failed in this pass; ``found``: what is
    there now.  An entry is ``open`` until it has ``max_tries`` tries, then ``given up``; it is ``done`` once it was found.
    """
    failed = failed.select(*LEDGER_KEY).distinct()
    waiting = stored.where("state <> 'done'").select(*LEDGER_KEY, F.col("attempts").alias("_before"))
    tries = F.least(F.coalesce("_before", F.lit(0)) + 1, F.lit(max_tries)).cast("int")
    raised = failed.join(waiting, LEDGER_KEY, "left").withColumn("attempts", tries)
    raised = raised.where("_before is null or attempts > _before").withColumn(
        "state", F.when(F.col("attempts") < max_tries, "open").otherwise("given up"))
    done = waiting.join(found.select(*LEDGER_KEY).distinct(), LEDGER_KEY, "left_semi").join(failed, LEDGER_KEY, "left_anti")
    done = done.select(*LEDGER_KEY, F.col("_before").alias("attempts"), F.lit("done").alias("state"))
    return raised.select(*LEDGER_KEY, "attempts", "state").unionByName(done)


def retry(quarantine: DataFrame, max_tries: int = MAX_TRIES) -> DataFrame:
    """Work that may be tried again: fewer than ``max_tries`` tries so far."""
    tries = quarantine.groupBy("step", "rule", "url").agg(F.sum("attempts").cast("bigint").alias("attempts"))
    return tries.where(F.col("attempts") < max_tries)
