"""Pages to records: rule patterns applied to page text.

A rule pattern is either a literal (``Pattern``, known when the plan is built)
or a column of a rule table; ``Ref`` hides the difference, so that one plan
serves any number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import fixed_values as fixed
from gleanery.functions.regex import Pattern, to_java
from gleanery.functions.text import first_filled, let
from gleanery.functions.titles import media_file_name, media_kind
from gleanery.functions.urls import resolve

COMPILED = "struct<java:string,groups:map<string,array<int>>,self_contained:boolean,error:string>"


@dataclass(frozen=True)
class Ref:
    java: Column
    groups: Column | dict[str, list[int]]
    self_contained: Column | bool

    @classmethod
    def of(cls, pattern: Pattern | str | Column) -> Ref:
        if isinstance(pattern, Column):
            return cls(pattern["java"], pattern["groups"], pattern["self_contained"])
        p = to_java(pattern) if isinstance(pattern, str) else pattern
        return cls(F.lit(p.java), p.groups, p.self_contained)

    def group(self, text: Column, index: Column | int) -> Column:
        return F.call_function("regexp_extract", text, self.java, F.lit(index))

    def field(self, text: Column, name: str) -> Column:
        """Text of a named group; a repeated name gives its last filled group."""
        if isinstance(self.groups, dict):
            found = [self.group(text, i) for i in reversed(self.groups.get(name, []))]
            value = first_filled(*found, "") if len(found) > 1 else F.coalesce(*found, F.lit(""))
        else:
            value = F.aggregate(self.indices(name), F.lit(""),
                                lambda acc, i: first_filled(self.group(text, i), acc))
        return value.alias(name)

    def indices(self, name: str) -> Column:
        none = F.array().cast("array<int>")
        if isinstance(self.groups, dict):
            found = self.groups.get(name, [])
            return F.array(*map(F.lit, found)) if found else none
        return F.coalesce(F.try_element_at(self.groups, F.lit(name)), none)

    def choose(self, alone: Column, otherwise: Column) -> Column:
        """``alone`` for a pattern that does not look around its match."""
        if isinstance(self.self_contained, bool):
            return alone if self.self_contained else otherwise
        return F.when(self.self_contained, alone).otherwise(otherwise)


def compile_patterns(rules: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace the pattern columns of a rule table by compiled patterns.

    A pattern that cannot be translated, or that the engine which will run it does not take, is switched off
    and carries its error.
    """

    @F.pandas_udf(COMPILED)
    def compiled(patterns: pd.Series) -> pd.DataFrame:
        done, errors = [], []
        for pattern in patterns:
            try:
                done.append(to_java(pattern))
                errors.append(None)
            except (ValueError, KeyError, IndexError) as e:
                done.append(Pattern(""))
                errors.append(str(e))
        return pd.DataFrame({
            "java": [p.java for p in done],
            "groups": [p.groups for p in done],
            "self_contained": [p.self_contained for p in done],
            "error": errors,
        })

    def tried(c: Column) -> Column:
        taken = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), c["java"]).isNotNull()
        refused = F.lit("not taken by java.util.regex")
        return F.when(taken, c).otherwise(c.withField("java", F.lit("")).withField("error", refused))

    translated = rules.withColumns({n: compiled(F.coalesce(F.col(n), F.lit(""))) for n in names})
    return translated.withColumns({n: tried(F.col(n)) for n in names})


def pattern_error(names: Sequence[str]) -> Column:
    """Reason ``bad_pattern:<rule field>`` of a compiled rule, else null."""
    return F.coalesce(*[F.when(F.col(n)["error"].isNotNull(), f"bad_pattern:{n}") for n in names])


def is_enabled(pattern: Pattern | str | Column) -> Column:
    """An empty pattern switches its step off, although it would match."""
    return Ref.of(pattern).java != ""


def is_match(text: Column, pattern: Pattern | str | Column) -> Column:
    ref = Ref.of(pattern)
    return (ref.java != "") & F.rlike(text, ref.java)


def all_matches(text: Column, pattern: Pattern | str | Column, fields: Sequence[str] | None = None) -> Column:
    """Array of structs, one per match in page order; a missing group gives ''.

    A literal pattern may do without ``fields``: its group names are the record.
    """
    ref = Ref.of(pattern)
    fields = list(ref.groups) if fields is None else fields
    whole = F.regexp_extract_all(text, ref.java, F.lit(0))

    # One pass over the page finds the matches, the groups are taken from them.
    by_match = F.transform(whole, lambda match: F.struct(*[ref.field(match, f) for f in fields]))

    # A pattern that looks around its match needs one pass per group.
    def by_group(field: str) -> Column:
        passes = F.transform(ref.indices(field), lambda i: F.regexp_extract_all(text, ref.java, i))
        blank = F.transform(whole, lambda _: F.lit(""))
        return F.aggregate(passes, blank, lambda acc, p: F.zip_with(p, acc, lambda a, b: first_filled(a, b)))

    zipped = F.transform(F.arrays_zip(*[by_group(f).alias(f) for f in fields]),
                         lambda z: F.struct(*[z[f].alias(f) for f in fields]))
    return F.when(ref.java != "", ref.choose(by_match, zipped)).otherwise(F.slice(by_match, 1, 0))


def whole_matches(text: Column, pattern: Pattern | str | Column) -> Column:
    ref = Ref.of(pattern)
    return F.when(ref.java != "", F.regexp_extract_all(text, ref.java, F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def first_match(text: Column, pattern: Pattern | str | Column, fields: Sequence[str]) -> Column:
    """Struct (matched, whole, fields...) of the first match."""
    ref = Ref.of(pattern)

    def record(whole: Column) -> Column:
        matched = F.coalesce((ref.java != "") & ((whole != "") | F.rlike(text, ref.java)), F.lit(False))
        source = ref.choose(whole, text)
        return F.struct(matched.alias("matched"), whole.alias("whole"), *[ref.field(source, f) for f in fields])

    return let(F.when(ref.java != "", ref.group(text, 0)).otherwise(F.lit("")), record)


def explode_matches(pages: DataFrame, keep: Sequence[str], matches: Column) -> DataFrame:
    """One row per match with its position; page text does not travel along."""
    return pages.select(*keep, F.posexplode(matches).alias("pos", "_match")).select(
        *keep, F.col("pos").cast("long"), "_match.*")


def region_matches(text: Column, region: Pattern | str | Column, item: Pattern | str | Column,
                   fields: Sequence[str]) -> Column:
    """Matches of ``item`` inside group ``key`` of the first match of ``region``."""
    return let(first_match(text, region, ["key"])["key"], lambda area: all_matches(area, item, fields))


def next_link(text: Column, pattern: Pattern | str | Column, base: Column, *, whole: bool = False) -> Column:
    """Absolute next-page link; null when the page has none."""
    found = first_match(text, pattern, [] if whole else ["key"])
    return let(found, lambda m: F.when(m["matched"] & (m["whole" if whole else "key"] != ""),
                                       resolve(m["whole" if whole else "key"], base)))


LIST_FIELDS = ["class", "title", "location", "publicyear", "actors", "director", "intro", "image", "url"]


def list_records(pages: DataFrame, keep: Sequence[str], text: Column, pattern: Pattern | str | Column) -> DataFrame:
    """Records of a series list page; ``intro`` also fills ``info``."""
    return explode_matches(pages, keep, all_matches(text, pattern, LIST_FIELDS)).withColumn("info", F.col("intro"))


def media_links(sources: DataFrame, keep: Sequence[str], text: Column) -> DataFrame:
    """One row per media link of a decoded source file."""
    links = whole_matches(text, fixed.MEDIA_LINK)
    return (
        sources.select(*keep, F.posexplode(links).alias("pos", "url"))
        .withColumn("pos", F.col("pos").cast("long"))
        .withColumn("kind", media_kind(F.col("url")))
        .withColumn("file_name", media_file_name(F.col("url")))
    )


def play_page_links(pages: DataFrame, keep: Sequence[str], text: Column, base: Column,
                    direct: Pattern | str | Column, source: Pattern | str | Column) -> DataFrame:
    """Direct media URL of a play page, else the link to its source file."""
    found = pages.select(
        *keep,
        first_match(text, direct, ["title", "url"]).alias("_direct"),
        first_match(text, source, ["source"]).alias("_source"),
        base.alias("_base"),
    )
    is_direct = F.col("_direct.matched") & (F.col("_direct.url") != "")
    return found.where(is_direct | F.col("_source.matched")).select(
        *keep,
        F.when(is_direct, "direct").otherwise("source").alias("leg"),
        F.when(is_direct, F.col("_direct.title")).otherwise("").alias("page_title"),
        F.when(is_direct, F.col("_direct.url")).otherwise(resolve(F.col("_source.source"), F.col("_base"))).alias("url"),
    )
