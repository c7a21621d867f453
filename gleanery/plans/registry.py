"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if (name or f.__name__) in QUERIES:
            raise ValueError(f"there is a query {name or f.__name__} already")
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOST_SQL = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_replace(value: str, pattern: str, to: str = "", times: int = 1) -> str:
    for _ in range(times):
        value = f"regexp_replace({value}, {sql_text(pattern)}, {sql_text(to)}, 'g')"
    return value


def sql_resolve(link: str, base: str) -> str:
    """CASE that makes a link absolute."""
    bare = rf"regexp_replace({base}, '[?#][\s\S]*$', '')"
    return rf"""CASE
      WHEN {link} = '' THEN ''
      WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN {link}
      WHEN starts_with({link}, '//') THEN regexp_extract({base}, '^([^:/?#]+:)', 1) || {link}
      WHEN starts_with({link}, '/') THEN regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1) || {link}
      WHEN starts_with({link}, '?') THEN {bare} || {link}
      WHEN starts_with({link}, '#') THEN regexp_replace({base}, '#[\s\S]*$', '') || {link}
      WHEN regexp_matches({bare}, '^[^/]*//[^/]*/') THEN regexp_extract({bare}, '^([\s\S]*/)', 1) || {link}
      ELSE {bare} || '/' || {link} END"""
