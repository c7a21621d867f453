"""What the passes of a poll leave behind, so that a pass looks at what changed and at what hangs on it.

A pass reads the text of its own pages, and of known pages that belong to a book or series one of whose pages it brought.  For that, each
pass keeps: its pages; the next links of the pages it opened; the items of the list pages it opened; and which
pages each book or series touched, missing ones included.  A page that lands wakes the books and series that touched it.

Tables lie in folders per pass.  A pass reads those of earlier passes only, and a repeated try replaces its own.  Rows
name the version of the rule they come from: a rule that was changed has no past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.functions.urls import url_key
from gleanery.operators.skew import is_small, lookup_join
from gleanery.session import names_in, remove, write_out


def version_of(rules: DataFrame) -> Column:
    return F.xxhash64(F.to_json(F.struct(*sorted(c for c in rules.columns))))


class Memory:
    def __init__(self, spark: SparkSession, path: str, number: int) -> None:
        self.spark, self.path, self.number = spark, path.rstrip("/"), number
        self.rules = self.keys = None
        self._begun: set[str] = set()

    # ------------------------------------------------------------- tables

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}/pass={self.number}"

    def _folders(self, table: str, upto: int) -> list[str]:
        passes = sorted(int(n.partition("=")[2]) for n in names_in(self.spark, f"{self.path}/{table}") if n.startswith("pass="))
        return [f"{self.path}/{table}/pass={n}" for n in passes if n <= upto]

    def _past(self, table: str, schema: str, upto: int) -> DataFrame:
        """Rows of the passes up to ``upto``."""
        folders = self._folders(table, upto)
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, pass bigint")
        reader = self.spark.read.option("basePath", f"{self.path}/{table}").schema(f"{schema}, pass bigint")
        return reader.parquet(*folders)

    def keep(self, table: str, rows: DataFrame) -> None:
        """Add rows (with ``rule``) to a table of this pass."""
        if table not in self._begun:
            remove(self.spark, [self._folder(table)])
            self._begun.add(table)
        rows.join(self._few(self.rules), "rule").write.mode("append").parquet(self._folder(table))

    def recall(self, table: str, schema: str, fresh: bool = True) -> DataFrame:
        """Rows of earlier passes under the rules as they are; without those of pages that have landed since, if ``fresh``."""
        names = [c.split()[0] for c in schema.split(", ")]
        if not self._folders(table, self.number - 1):
            return self.spark.createDataFrame([], schema)
        rows = self._past(table, f"{schema}, _version bigint", self.number - 1).join(
            self._few(self.rules), ["rule", "_version"], "left_semi").select(*names, "pass")
        return (self._since(rows) if fresh else rows).select(*names)

    def _since(self, rows: DataFrame) -> DataFrame:
        """Rows whose page has not landed in their pass's later ones."""
        landed = self._past("keys", "key string", self.number).select("key", F.col("pass").alias("_landed"))
        # Only keys that landed after they were looked at; of a pass's own pages none.
        newest = landed.groupBy("key").agg(F.max("_landed").alias("_landed"))
        stale = lookup_join(rows.select("key", "pass").distinct(), newest, ["key"], "inner", ["pass"]).where("_landed > pass")
        return lookup_join(rows, write_out(stale.select("key", "pass"), "stale"), ["key", "pass"], "left_anti", rows.columns)

    @staticmethod
    def _few(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if is_small(rows) else rows

    # -------------------------------------------------------------- pages

    def begin(self, pages: DataFrame, rules: DataFrame) -> None:
        """Take up the pages of this pass (page_id, url, and html or content)."""
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", key string"
        keyed = pages.withColumn("key", url_key(F.col("url")))
        keyed.sortWithinPartitions("key").write.mode("overwrite").parquet(self._folder("pages"))
        self.keys = self.landed().select("key").distinct()
        self.keys.write.mode("overwrite").parquet(self._folder("keys"))
        self.keys = self.spark.read.schema("key string").parquet(self._folder("keys"))
        self.rules = write_out(rules.select("rule", version_of(rules).alias("_version")), "versions")

    def landed(self) -> DataFrame:
        """The pages of this pass."""
        return self.spark.read.schema(self.schema).parquet(self._folder("pages")).withColumn("pass", F.lit(self.number).cast("bigint"))

    def pages(self) -> DataFrame:
        """All pages so far, with the pass that brought them."""
        return self._past("pages", self.schema, self.number)

    # ------------------------------------------------------- what is awake

    def awake(self, sources: DataFrame, again: DataFrame) -> DataFrame:
        """Of ``sources`` (source, rule, ...) those that are new, touched a page that landed now, or one of the keys ``again``.

        ``again`` has the column key.
        """
        touched = self.recall("touched", "rule string, source string, key string", fresh=False)
        now = self.keys.unionByName(again.select("key")).distinct()
        woken = lookup_join(touched, write_out(now, "landed"), ["key"], "left_semi", ["source"]).select("source").distinct()
        asleep = touched.select("source").distinct().join(woken, "source", "left_anti")
        return lookup_join(sources, write_out(asleep, "asleep"), ["source"], "left_anti", ["source"])
