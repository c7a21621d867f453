"""Tables of the catalog."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.fixed_values import QVOD

PAGE = "page_id bigint, url string, html string"

BOOK_RULE = (
    "Name string, TargetSiteName string, TargetSiteUrl string, SrcSite string, SiteName string, SiteDomain string, "
    "CharSet string, ListUrl string, ListUrlNextRule string, SearchUrl string, IsPostSearch boolean, ListRule string, "
    "SearchRule string, InfoRule string, FaceWidth int, FaceHeight int, ChapterListUrlRule string, "
    "ChapterListRule string, ContentRule string, NextContentRule string, NextChapterUrlRule string, "
    "ImageCheckRule string"
)

SERIES_RULE = (
    "Name string, SiteName string, IsMovie boolean, IsSearchRule boolean, UseTagAsClass boolean, "
    "UseLocationAsClass boolean, DefaultClass string, Encoding string, ListPageUrl string, NextListRule string, "
    "ListInfoRule string, InfoRule string, KuaibAreaRule string, BaiduAreaRule string, KuaibDramaRule string, "
    "BaiduDramaRule string, DramaPageKuaibRule string, DramaPageBaiduRule string, SourceKuaibRule string, "
    "SourceBaiduRule string"
)

TABLES: dict[str, str] = {
    "class": "id bigint, class_name string, parent_id bigint, model_id int",
    "book": "id bigint, title string, author string, class_id bigint, class_name string, intro string, "
                "length int, status smallint, last_chapter_id bigint, last_chapter_title string, enable boolean, "
                "click_count bigint, reply_count bigint, save_count bigint, "
                "add_time timestamp_ntz, update_time timestamp_ntz",
    "chapter": "id bigint, book_id bigint, book_title string, class_id bigint, class_name string, title string, "
                   "text_length int, chapter_index int, enable boolean, is_free boolean, update_time timestamp_ntz",
    "chapter_content": "chapter_id bigint, title string, content string, "
                           "is_image_chapter boolean, is_temp boolean",
    "series": "id bigint, class_id bigint, class_name string, title string, standard_title string, "
                  "director string, actors string, location string, public_year string, intro string, info string, "
                  "face_image string, status smallint, enable boolean, click_count bigint, "
                  "last_drama_title string, insert_time timestamp_ntz, update_time timestamp_ntz",
    "episode": "id bigint, kind string, movie_id bigint, movie_title string, title string, url string, "
                   "enable boolean, update_time timestamp_ntz",
    "pointer": "parent string, parent_id bigint, last_id bigint, last_title string, update_time timestamp_ntz",
    "cover": "parent string, id bigint, image_url string, path string",
    "quarantine": "step string, rule string, url string, title string, reason string, attempts int",
    "ledger": "step string, rule string, url string, attempts int, state string",
}

# Longest text a column may hold.  Longer rows are set aside, never cut.
MAX_LENGTHS = {
    "class": {"class_name": 50},
    "book": {"title": 100, "author": 100, "class_name": 50},
    "chapter": {"title": 200},
    "series": {"title": 50, "standard_title": 50, "class_name": 50, "director": 50, "actors": 500, "location": 50,
               "public_year": 50, "face_image": 500},
    "episode": {"title": 255, "movie_title": 255, "url": 500},
}
MAX_LENGTHS_QVOD = {"title": 50, "movie_title": 50}

DEFAULTS: dict[str, dict[str, Any]] = {
    "book": {"last_chapter_id": 0, "last_chapter_title": "", "enable": True,
             "click_count": 0, "reply_count": 0, "save_count": 0},
    "chapter": {"chapter_index": 0, "enable": True, "is_free": True},
    "chapter_content": {"is_image_chapter": False, "is_temp": False},
    "series": {"status": 0, "enable": True, "click_count": 0, "last_drama_title": ""},
    "episode": {"enable": True},
}


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of a table."""
    return [tuple(c.split()) for c in TABLES[table].split(", ")]


def with_defaults(df: DataFrame, table: str, values: Mapping[str, Any] | None = None) -> DataFrame:
    """Project ``df`` on the columns of a table; absent ones get their default."""
    known = {**DEFAULTS.get(table, {}), **(values or {})}

    def column(name: str, kind: str) -> Column:
        if name in df.columns:
            value = F.col(name)
        else:
            value = known.get(name)
            value = value if isinstance(value, Column) else F.lit(value)
        return value.cast(kind).alias(name)

    return df.select(*[column(*c) for c in columns(table)])


def too_long(df: DataFrame, table: str) -> Column:
    """Reason ``too_long:<column>`` of a row that a table cannot hold, else null."""
    limits = [(c, F.lit(n)) for c, n in MAX_LENGTHS.get(table, {}).items()]
    if table == "episode":
        limits += [(c, F.when(F.col("kind") == QVOD, n)) for c, n in MAX_LENGTHS_QVOD.items()]
    return F.coalesce(
        *[F.when(F.length(c) > n, f"too_long:{c}") for c, n in limits if c in df.columns],
        F.lit(None).cast("string"),
    )
