"""The stored catalog: Parquet tables that grow by batches.

A try to write a batch has a folder of its own in every table, ``<table>/batch=<n>/attempt=<id>``.  A batch is
committed by the file ``_commits/<n>``, which names the try that counts and is created only if no other is there: of several
tries, or of several writers, one wins, and readers see all of its tables or none.  Numbers are claimed in the same way, by ``_claims/<n>``.
Nothing is rewritten: later values of a parent row (its last chapter, its update time) are rows of ``pointer``, of
which the newest counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.functions import fixed_values as fixed
from gleanery.operators.skew import relevant
from gleanery.schemas import TABLES, with_defaults
from gleanery.session import create_once, names_in, read_small, remove, write_out


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    path: str
    # Commits are never changed, so each is read once.
    _known: dict[int, dict] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: Sequence[str] = tuple(TABLES)) -> Catalog:
        """An empty catalog that knows the class ``其他``."""
        catalog = cls(spark, path.rstrip("/"))
        seed = {"class": [(1, fixed.DEFAULT_CLASS, 0, fixed.BOOK_MODEL_ID)]}
        catalog.commit(0, {t: spark.createDataFrame(seed.get(t, []), TABLES[t]).coalesce(1) for t in tables})
        return catalog

    def commits(self) -> dict[int, dict]:
        """The committed batches: number to writer, attempt and tables."""
        for name in names_in(self.spark, f"{self.path}/_commits"):
            if name.isdigit() and int(name) not in self._known:
                text = read_small(self.spark, f"{self.path}/_commits/{name}")
                if text and text.endswith("}"):  # else it is being written
                    self._known[int(name)] = json.loads(text)
        return dict(self._known)

    def last_batch(self) -> int:
        return max(self.commits())

    def claim(self, writer: str) -> int:
        """The batch number of a writer's unit of work.

        A name, such as stream and micro-batch, that has a number keeps it, so that a repeated try
        is one of the same batch; a new name gets the next number.  Writers that ask at the same time get different
        numbers; a number whose writer was lost right after taking it stays unused.
        """
        mine = f"{self.path}/_writers/{hashlib.sha256(writer.encode()).hexdigest()}"
        known = read_small(self.spark, mine)
        if known:
            return int(known)
        taken = [int(n) for n in names_in(self.spark, f"{self.path}/_claims") if n.isdigit()]
        number = max([*taken, self.last_batch()]) + 1
        while not create_once(self.spark, f"{self.path}/_claims/{number}", writer):
            number += 1
        # Of two tries of one writer the first counts.
        return number if create_once(self.spark, mine, str(number)) else int(read_small(self.spark, mine))

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of the committed batches, of those before ``before`` if given."""
        done = {n: c for n, c in self.commits().items() if name in c["tables"] and (before is None or n < before)}
        if not done:
            return self.spark.createDataFrame([], f"{TABLES[name]}, batch bigint")
        folders = [f"{self.path}/{name}/batch={n}/attempt={c['attempt']}" for n, c in sorted(done.items())]
        reader = self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{TABLES[name]}, batch bigint, attempt string")
        return reader.parquet(*folders).drop("attempt")

    def commit(self, batch: int, tables: dict[str, DataFrame], writer: str = "") -> None:
        """Write a batch and make it visible, all at once.

        A batch that this writer has committed before stays as it is; a number that another writer has claimed or committed is refused.
        """
        self._check(batch, writer)
        if batch in self.commits():
            return
        attempt = uuid.uuid4().hex
        folders = {name: f"{self.path}/{name}/batch={batch}/attempt={attempt}" for name in tables}
        for name, rows in tables.items():
            with_defaults(rows, name).write.parquet(folders[name])
        what = json.dumps({"writer": writer, "attempt": attempt, "tables": sorted(tables)})
        if not create_once(self.spark, f"{self.path}/_commits/{batch}", what):
            remove(self.spark, list(folders.values()))
            self._check(batch, writer)

    def _check(self, batch: int, writer: str) -> None:
        owner = read_small(self.spark, f"{self.path}/_claims/{batch}")
        if owner is not None and owner != writer:
            raise ValueError(f"batch {batch} was claimed by another writer")
        if batch and self.commits().get(batch, {"writer": writer})["writer"] != writer:
            raise ValueError(f"batch {batch} was committed by another writer")

    def remove_leftovers(self) -> list[str]:
        """Delete what tries of committed batches that do not count have left; gives the folders."""
        left = []
        for name in TABLES:
            for batch, commit in self.commits().items():
                folder = f"{self.path}/{name}/batch={batch}"
                left += [f"{folder}/{a}" for a in names_in(self.spark, folder) if a != f"attempt={commit['attempt']}"]
        remove(self.spark, left)
        return left

    def books(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Books with their last chapter; only those in ``of`` (title, author) if given."""
        return self._with_pointers("book", before, of, ["title", "author"], {
            "last_chapter_id": "last_id", "last_chapter_title": "last_title", "update_time": "update_time"})

    def series(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Series with their last episode; only those in ``of`` (title) if given."""
        return self._with_pointers("series", before, of, ["title"], {
            "last_drama_title": "last_title", "update_time": "update_time"})

    def ledger(self, before: int | None = None) -> DataFrame:
        """The newest entry of everything that failed."""
        newest = F.max_by(F.struct("attempts", "state"), "batch")
        return self.table("ledger", before).groupBy("step", "rule", "url").agg(newest.alias("_newest")).select(
            "step", "rule", "url", "_newest.*")

    def _with_pointers(self, name: str, before: int | None, of: DataFrame | None, on: list[str],
                       values: dict[str, str]) -> DataFrame:
        parents = self.table(name, before).drop("batch")
        rows = self.table("pointer", before).where(F.col("parent") == name).withColumnRenamed("parent_id", "id")
        if of is not None:
            parents = write_out(relevant(parents, of, on), name)
            rows = relevant(rows, parents, ["id"])
        newest = F.max_by(F.struct("last_id", "last_title", "update_time"), F.struct("batch", "last_id"))
        newest = rows.groupBy("id").agg(newest.alias("_newest"))
        joined = parents.join(newest, "id", "left")
        return joined.select(*[
            F.coalesce(f"_newest.{values[c]}", c).alias(c) if c in values else F.col(c) for c in parents.columns])
