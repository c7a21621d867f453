from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import sites
from gleanery.plans.books import harvest_books
from gleanery.plans.series import harvest_series
from gleanery.sources.catalog import Catalog


def at(day):
    return F.expr(f"timestamp_ntz'2024-01-0{day} 00:00:00'")


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    """A pass, the same pass again, a pass with two more chapters."""
    catalog = Catalog.create(spark, str(tmp_path_factory.mktemp("books")))
    rules = sites.book_rules(spark).unionByName(sites.book_rules(spark, Name="broken", ListRule="(?<title>["))
    blacklist = spark.createDataFrame([("黑书",)], "title string")
    for batch, extra in [(1, ()), (2, ()), (3, (4, 5))]:
        harvest_books(catalog, rules, sites.book_pages(spark, extra_chapters=extra), batch, blacklist=blacklist,
                      replace_list=[("说明", "介绍")], as_of=at(batch))
    return catalog


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_books(books):
    got = rows(books.table("book").where("batch = 1"), "id", "title", "author", "class_name", "length", "status", "intro")
    assert got == [(1, "乙书", "", "武侠", 345, 1, "介绍 "), (2, "甲书", "张三", "玄幻", 0, 0, "介绍 ")]
    assert books.table("book").where("batch > 1").count() == 0


def test_book_classes(books):
    assert rows(books.table("class"), "id", "class_name", "parent_id") == [
        (1, "其他", 0), (2, "武侠", 1), (3, "玄幻", 1)]


def test_chapters(books):
    got = rows(books.table("chapter").where("batch = 1"), "id", "book_title", "class_name", "title", "text_length")
    # Chapter 二 of book 乙书 has no page, which ends the pass for that book.
    assert got == [(1, "乙书", "武侠", "一", 5), (2, "乙书", "武侠", "一续", 10),
                   (3, "甲书", "玄幻", "第1章 甲", 13), (4, "甲书", "玄幻", "第2章 甲", 12), (5, "甲书", "玄幻", "第3章 甲", 5)]


def test_chapter_texts(books):
    got = rows(books.table("chapter_content").where("batch = 1"), "chapter_id", "content")
    assert got == [(1, "b one"), (2, "b one more"), (3, "一&amp;二三".replace("&amp;", "&")), (4, "abx"), (5, "third")]


def test_second_pass_adds_nothing(books):
    for table in ("book", "chapter", "class", "chapter_content"):
        assert books.table(table).where("batch = 2").count() == 0, table


def test_third_pass_resumes(books):
    assert rows(books.table("chapter").where("batch = 3"), "id", "title") == [(6, "第4章 甲"), (7, "第5章 甲")]
    assert rows(books.books(), "title", "last_chapter_id", "last_chapter_title", "update_time") == [
        ("乙书", 2, "一续", at_value(1)), ("甲书", 7, "第5章 甲", at_value(3))]


def at_value(day):
    import datetime

    return datetime.datetime(2024, 1, day)


def test_book_covers_and_quarantine(books):
    assert rows(books.table("cover").where("batch = 1"), "id", "image_url", "path") == [
        (2, "http://b.example/a.jpg", "http://t.example/e/api/xmlrpc.aspx?a=savebookface&id=2")]
    assert rows(books.table("quarantine").where("batch = 1"), "step", "rule", "url", "reason") == [
        ("chapter", "books", "http://b.example/b/2.html", "missing_page"),
        ("info", "books", "http://b.example/none.html", "missing_page"),
        ("info", "books", "http://b.example/odd.html", "no_match:InfoRule"),
        ("rule", "broken", "http://b.example/list1.html", "bad_pattern:ListRule")]


def test_batch_again_replaces_itself(books, spark):
    before = rows(books.table("chapter"), "id", "title")
    harvest_books(books, sites.book_rules(spark), sites.book_pages(spark, extra_chapters=(4, 5)), 3, as_of=at(3))
    assert rows(books.table("chapter"), "id", "title") == before


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    catalog = Catalog.create(spark, str(tmp_path_factory.mktemp("series")))
    old = spark.createDataFrame([(7, "怀旧老片集", "")], "id bigint, title string, face_image string")
    catalog.commit(1, {"series": old})
    rules = sites.series_rules(spark)
    harvest_series(catalog, rules, sites.series_pages(spark), 2, as_of=at(2))
    harvest_series(catalog, rules, sites.series_pages(spark), 3, as_of=at(3))
    harvest_series(catalog, rules, sites.series_pages(spark, sites.SOURCE + "#qvod://6|66|Show09.mp4"), 4, as_of=at(4))
    return catalog


def test_series(series):
    got = rows(series.table("series").where("batch = 2"), "id", "title", "class_name", "location", "public_year", "intro",
               "face_image", "standard_title")
    assert got == [(8, "Show", "喜剧", "大陆", "2012", " 介绍", "/u/MovieFace/8.jpg", "Show")]
    assert series.table("series").where("batch > 2").count() == 0


def test_episodes(series):
    got = rows(series.table("episode").where("batch = 2"), "kind", "movie_id", "movie_title", "title", "url")
    assert got == [
        ("baidu", 8, "Show", "第01集", "bdhd://2|22|[www.x.com]Show_01.avi"),
        ("baidu", 8, "Show", "第02集", "bdhd://1|11|Show国语02.rmvb"),
        ("qvod", 7, "怀旧老片集", "上", "qvod://9|9|x.rmvb"),
        ("qvod", 7, "怀旧老片集", "全集", "qvod://8|8|y.rmvb"),
        ("qvod", 8, "Show", "03上", "qvod://4|44|Show03上.wmv"),
    ]
    assert series.table("episode").where("batch = 3").count() == 0
    assert rows(series.table("episode").where("batch = 4"), "kind", "title") == [("qvod", "第09集")]


def test_series_pointers(series):
    assert rows(series.series(), "id", "last_drama_title", "update_time") == [
        (7, "全集", at_value(2)), (8, "第09集", at_value(4))]


def test_series_covers_and_quarantine(series):
    assert rows(series.table("cover").where("batch = 2"), "id", "image_url", "path") == [
        (7, "http://s.example/s/../i/x.jpg", "/u/MovieFace/7.jpg"),
        (8, "http://s.example/s/../i/x.jpg", "/u/MovieFace/8.jpg")]
    assert rows(series.table("quarantine").where("batch = 2"), "step", "url", "title", "reason") == [
        ("info", "http://s.example/s/3.html", "...", "empty_title"),
        ("info", "http://s.example/s/4.html", "无配", "no_match:InfoRule"),
        ("info", "http://s.example/s/5.html", "缺页", "missing_page"),
        ("source", "bdhd://3|33.mp4", "", "no_file_name")]


def test_older_version(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path))
    old = spark.createDataFrame([(7, "怀旧老片集", "x"), (9, "Show...", "x")], "id bigint, title string, face_image string")
    catalog.commit(1, {"series": old})
    harvest_series(catalog, sites.series_rules(spark), sites.series_pages(spark), 2, older=True, as_of=at(2))
    assert rows(catalog.table("series").where("batch = 2"), "id", "title") == [(10, "老片")]
    assert rows(catalog.table("episode").where("movie_id = 9"), "kind", "title") == [
        ("baidu", "[]show01"), ("baidu", "show-01"), ("baidu", "show国语02"), ("qvod", "show03上")]


def test_chapters_without_titles_are_all_kept(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path))
    rules = sites.book_rules(spark, ContentRule=r"<article>(?<content>[\s\S]*?)</article>")
    harvest_books(catalog, rules, sites.book_pages(spark, without=()), 1, as_of=at(1))
    assert catalog.table("chapter").count() == 5


def test_numbers_are_claimed_once(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path))
    assert [catalog.claim(w) for w in ("a", "b", "a")] == [1, 2, 1]
    empty = {"class": spark.createDataFrame([(5, "x", 0, 4)], "id long, class_name string, parent_id long, model_id int")}
    catalog.commit(2, empty, "b")
    catalog.commit(2, empty, "b")
    assert catalog.table("class").count() == 2  # batch 1 is not committed, batch 2 counts once
    with pytest.raises(ValueError):
        catalog.commit(2, empty, "c")


def item_pages(spark, pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages.items())], sites.PAGE)


def test_bad_patterns_stop_no_other_rule(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path))
    bad = {"python name": "(?P<title>x)", "branch reset": "(?|(x)|(y))", "open class": "[a", "subtraction": "[a-z-[x]]+",
           "no such group": r"\k<x>"}
    rules = sites.book_rules(spark)
    for name, pattern in bad.items():
        rules = rules.unionByName(sites.book_rules(spark, Name=name, ContentRule=pattern))
    harvest_books(catalog, rules, sites.book_pages(spark), 1, as_of=at(1))
    assert catalog.table("chapter").count() == 5
    assert rows(catalog.table("quarantine").where("step = 'rule'"), "rule", "reason") == sorted(
        (name, "bad_pattern:ContentRule") for name in bad)


def test_walks_go_on_from_other_hosts(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path))
    far, farther = "http://c.example:8080", "http://d.example"
    more = {
        f"{far}/2.html": sites.chapter("far", "two", onward=f"{far}/3.html", more=f"{farther}/2b.html"),
        f"{farther}/2b.html": sites.chapter("", " and more", more=f"{farther}/2c.html"),
        f"{farther}/2c.html": sites.chapter("", " to the end"),
        f"{far}/3.html": sites.chapter("farther", "three"),
    }
    pages = {r.url: r.html for r in sites.book_pages(spark).where("page_id >= 0").collect()}
    pages["http://b.example/a/3.html"] = sites.chapter("near", "one", onward=f"{far}/2.html")
    harvest_books(catalog, sites.book_rules(spark), item_pages(spark, {**pages, **more}), 1, as_of=at(1))
    texts = catalog.table("chapter_content").select("title", "content").where("title in ('near', 'far', 'farther')")
    assert rows(texts, "title", "content") == [("far", "two and more to the end"), ("farther", "three"), ("near", "one")]


def test_raw_pages_are_decoded_by_the_charset_of_the_rule(spark, tmp_path):
    pages = sites.book_pages(spark, without=())
    raw = spark.createDataFrame([(r.page_id, r.url, bytearray(r.html.encode("gb18030"))) for r in pages.collect()],
                                "page_id bigint, url string, content binary")
    rules = sites.book_rules(spark, CharSet="gb2312").unionByName(sites.book_rules(spark, Name="odd", CharSet="x-unheard-of"))
    decoded = Catalog.create(spark, str(tmp_path))
    harvest_books(decoded, rules, raw, 1, as_of=at(1))
    assert rows(decoded.table("chapter_content"), "chapter_id", "content") == [
        (1, "b one"), (2, "b one more"), (3, "一&二三"), (4, "abx"), (5, "third")]
    assert rows(decoded.table("quarantine").where("step = 'rule'"), "rule", "reason") == [("odd", "bad_charset:CharSet")]
