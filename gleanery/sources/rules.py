"""Harvest rules as XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators.extract import compile_patterns
from gleanery.schemas import BOOK_RULE, SERIES_RULE

BOOK, SERIES = "BookRule", "MovieRule"
SCHEMAS = {BOOK: BOOK_RULE, SERIES: SERIES_RULE}
# The field that names the charset of a site's pages.
CHARSETS = {BOOK: "CharSet", SERIES: "Encoding"}
PATTERNS = {
    BOOK: ["ListUrlNextRule", "ListRule", "InfoRule", "ChapterListUrlRule", "ChapterListRule", "ContentRule",
           "NextContentRule", "NextChapterUrlRule"],
    SERIES: ["NextListRule", "ListInfoRule", "InfoRule", "KuaibAreaRule", "BaiduAreaRule", "KuaibDramaRule",
             "BaiduDramaRule", "DramaPageKuaibRule", "DramaPageBaiduRule"],
}


def read_rules(spark: SparkSession, path: str, kind: str, glob: str = "*.xml") -> DataFrame:
    """All rules of a folder; an empty element reads as ''."""
    rules = (
        spark.read.format("xml").option("rowTag", kind).option("pathGlobFilter", glob).option("nullValue", "")
        .schema(SCHEMAS[kind]).load(path)
    )
    return rules.na.fill("")


def write_rules(rules: DataFrame, path: str, kind: str) -> None:
    rules.write.format("xml").option("rootTag", f"{kind}s").option("rowTag", kind).mode("append").save(path)


def compile_rules(rules: DataFrame, kind: str) -> DataFrame:
    """Rules with their patterns compiled; the columns become structs."""
    return compile_patterns(rules, PATTERNS[kind])
