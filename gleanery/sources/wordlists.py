"""Word lists kept as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file, without carriage returns."""
    whole = spark.read.text(path, wholetext=True)
    return split_lines(whole, "value")


def split_lines(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(
        "pos", F.rtrim(F.col("line"), F.lit("\r")).alias("line"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file whose order does not matter; read in splits."""
    return spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("line"))


def blacklist(lines: DataFrame) -> DataFrame:
    """Titles to leave out, one per line."""
    return lines.select(F.col("line").alias("title")).distinct()


def replace_rules(lines: DataFrame) -> DataFrame:
    """(pos, pattern, replacement): ``pattern``, optionally ``|replacement``."""
    fields = F.split("line", r"\|", -1)
    return lines.select(
        "pos", F.get(fields, F.lit(0)).alias("pattern"),
        F.coalesce(F.get(fields, F.lit(1)), F.lit("")).alias("replacement"),
    ).where("pattern <> ''")


def load_replace_list(rules: DataFrame) -> list[tuple[str, str]]:
    """The replace rules in file order, to be built into plans."""
    return [(r["pattern"], r["replacement"]) for r in rules.orderBy("pos").toLocalIterator()]
