"""The page corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.functions.urls import host, url_key
from gleanery.operators.skew import lookup_join
from gleanery.schemas import PAGE
from gleanery.session import counted, write_out

# Pages in these charsets use characters of a superset.
SUPERSETS = {"gb2312": "gb18030", "gbk": "gb18030"}
# With these, decode() takes every charset of the JVM and puts U+FFFD for malformed bytes.
JVM_SETTINGS = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", host(F.col("url")))


def read_raw(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """(url, content) of page files; the path stands for the URL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return files.load(path).select(F.col("path").alias("url"), "content")


def url_of_file(path: Column) -> Column:
    """URL of a page file that is named by it, percent-encoded; of other files the path."""
    name = F.try_url_decode(F.regexp_extract(path, "([^/]*)$", 1))
    return F.when(F.rlike(name, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), name).otherwise(path)


def _legacy_decode(content: Column, charset: Column) -> Column:
    @F.pandas_udf("string")
    def decoded(data: pd.Series, names: pd.Series) -> pd.Series:
        def one(data: bytes | None, name: str) -> str | None:
            try:
                return None if data is None else bytes(data).decode(name, "replace")
            except LookupError:
                return None

        return pd.Series([one(d, n) for d, n in zip(data, names)], dtype=object)

    return decoded(content, charset)


def charset_name(charset: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(charset, F.lit("")), F.lit("utf-8")))


def superset(charset: Column) -> Column:
    """The charset that pages in ``charset`` are read by."""
    wide = F.lit(None)
    for narrow, wider in SUPERSETS.items():
        wide = F.when(charset == narrow, wider).otherwise(wide)
    return F.coalesce(wide, charset)


def is_charset(charset: Column) -> Column:
    """Whether the JVM knows a charset; no name counts as UTF-8."""
    supported = F.try_reflect(F.lit("java.nio.charset.Charset"), F.lit("isSupported"), superset(charset_name(charset)))
    return F.coalesce(supported == "true", F.lit(False))


def decode_pages(raw: DataFrame, content: str = "content", charset: str = "charset") -> DataFrame:
    """Raw bytes to the text column ``html`` by the charset of each row; none counts as UTF-8.

    A malformed byte becomes U+FFFD.  An unknown charset gives a null ``html``: such rows are for
    the quarantine.  UTF-8, and all charsets where the session allows it, is decoded in the JVM; only the rest takes
    the Arrow path.
    """
    named = raw.withColumn(charset, charset_name(F.col(charset)))
    wide = superset(F.col(charset))
    if all(raw.sparkSession.conf.get(s, "false") == "true" for s in JVM_SETTINGS):
        decoded = F.when(is_charset(F.col(charset)), F.call_function("decode", F.col(content), wide))
        return named.withColumn("html", decoded).drop(content)
    common = F.col(charset) == "utf-8"
    direct = named.where(common).withColumn("html", F.make_valid_utf8(F.col(content).cast("string")))
    legacy = named.where(~common).withColumn("html", _legacy_decode(F.col(content), wide))
    return direct.unionByName(legacy).drop(content)


def latest_pages(pages: DataFrame) -> DataFrame:
    """One page per URL, the one with the highest id; of rows that share an id as well, one.

    Only the ids of outdated and of repeated pages are joined; page text is not sorted.
    """
    keys = pages.select("page_id", url_key(F.col("url")).alias("_url"))
    newest = keys.groupBy("_url").agg(F.max("page_id").alias("_newest"), F.count("*").alias("_copies"))
    repeated = write_out(newest.where("_copies > 1").select("_url", "_newest"), "repeated")
    older = lookup_join(keys, repeated, ["_url"], "inner", ["page_id"]).where("page_id < _newest")
    outdated = write_out(older.select("page_id"), "outdated")
    pages = lookup_join(pages, outdated, ["page_id"], "left_anti", ["page_id"])
    same, rows = counted(keys.groupBy("page_id").count().where("count > 1").select("page_id"), "same-id")
    if not rows:
        return pages
    twice = lookup_join(pages, same, ["page_id"], "left_semi", ["page_id"])
    once = lookup_join(pages, same, ["page_id"], "left_anti", ["page_id"])
    return once.unionByName(twice.withColumn("_url", url_key(F.col("url"))).dropDuplicates(["page_id", "_url"]).drop("_url"))


def rule_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with the pages of its site; both have the column ``host``."""
    return lookup_join(pages, rules, ["host"], "inner", ["page_id"])
