"""Titles of series, chapters and episodes as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleanery.functions import fixed_values as fixed
from gleanery.functions.regex import to_java
from gleanery.functions.text import let


def standard_title(title: Column) -> Column:
    """A title that is safe as a path: no doubled slashes, no reserved marks."""
    return F.translate(F.regexp_replace(title, "/{2,}", "/"), ":|><*?", "__")


def _shape(title: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(title, to_java(pattern).java, 0), F.lit(""))


def recognise_chapter(title: Column) -> Column:
    """Struct (title, recognised): the first known shape found in the title."""
    found = F.coalesce(*[_shape(title, p) for p in fixed.CHAPTER_SHAPES])
    return let(found, lambda f: F.struct(F.coalesce(f, title).alias("title"), f.isNotNull().alias("recognised")))


def trim_chapter(title: Column) -> Column:
    for pattern in fixed.CHAPTER_TRIMS:
        title = F.regexp_replace(title, to_java(pattern).java, "")
    return title


def chapter_title(title: Column) -> Column:
    """Struct (title, recognised) after recognition and trimming."""
    return let(recognise_chapter(title), lambda r: F.struct(
        trim_chapter(r["title"]).alias("title"), r["recognised"].alias("recognised")))


def _drop(text: Column, strings: list[str]) -> Column:
    for s in strings:
        text = F.replace(text, F.lit(s), F.lit(""))
    return text


def media_file_name(link: Column) -> Column:
    """Third field of a media link; null when the link has fewer."""
    return F.get(F.split(link, r"\|", -1), F.lit(2))


def media_kind(link: Column) -> Column:
    return F.when(F.startswith(link, F.lit(fixed.BAIDU_SCHEME)), fixed.BAIDU).otherwise(fixed.QVOD)


def _numbered(title: Column) -> Column:
    return let(title, lambda t: F.when(
        F.rlike(t, F.lit(r"\A[0-9]+\z")), F.format_string(fixed.EPISODE_NUMBER, t)).otherwise(t))


def _base_title(name: Column, series_title: Column) -> Column:
    text = F.lower(F.replace(name, series_title, F.lit("")))
    text = F.regexp_replace(text, fixed.MEDIA_DOMAIN, "")
    return _drop(text, fixed.MEDIA_EXTENSIONS + [" ", ".", "_"])


def episode_title(name: Column, series_title: Column) -> Column:
    """Episode title from a media file name: what is left besides the series."""
    bare_series = _drop(series_title, fixed.SERIES_TITLE_NOISE)
    return _numbered(_drop(_base_title(name, bare_series), fixed.EPISODE_NOISE_EXTRA))


def episode_title_basic(name: Column, series_title: Column) -> Column:
    """The older, simpler clean-up: no brackets, language or disc marks."""
    return _numbered(_base_title(name, series_title))
