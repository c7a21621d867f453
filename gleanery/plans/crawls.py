"""Queries: whole jobs, on crawls that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanery.plans.assembly import DOMAIN_SQL, EXTENSIONS, SOURCES_SQL, _numbered, _strip, sources_of
from gleanery.plans.books import harvest_books
from gleanery.plans.cleaning import sql_entities, sql_filter
from gleanery.plans.registry import query, table
from gleanery.plans.series import harvest_series
from gleanery.schemas import BOOK_RULE, SERIES_RULE
from gleanery.session import new_path, write_out
from gleanery.sources.catalog import Catalog
from gleanery.streaming.harvest import poll_books

LIST_SIZE = 20
SITES = 4


def rules_of(spark: SparkSession, ddl: str, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def address(*parts: Column | str) -> Column:
    site = F.format_string("http://s%d.example.com", F.col("site"))
    return F.concat(site, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def numbered(parts: list[DataFrame]) -> DataFrame:
    """Pages (url, html) with an id that follows from the URL."""
    pages = parts[0]
    for p in parts[1:]:
        pages = pages.unionByName(p)
    return write_out(pages.select(F.xxhash64("url").alias("page_id"), "url", "html"), "crawl")


def list_pages(entries: DataFrame, item: Column) -> DataFrame:
    """List pages of at most ``LIST_SIZE`` entries (site, n), linked one to the next."""
    paged = entries.withColumn("list", F.floor(F.col("n") / LIST_SIZE)).groupBy("site", "list").agg(
        F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    following = paged.select("site", (F.col("list") - 1).alias("list"), F.lit(True).alias("more"))
    onward = F.when(F.col("more"), F.format_string('<a rel="next" href="/list%d.html">', F.col("list") + 1))
    return paged.join(following, ["site", "list"], "left").select(
        address("/list", F.col("list").cast("string"), ".html").alias("url"),
        F.concat("items", F.coalesce(onward, F.lit(""))).alias("html"))


@query(f"""
SELECT 'book ' || conv_id AS book_title, 'turn ' || turn AS title, CAST(length(text) AS INT) AS text_length,
       {sql_entities(sql_filter('text'))} AS content FROM conversations""")
def book_job(spark, sf_dir):
    """Four sites: lists of books, an info page per book, a chain of chapter pages."""
    rules = rules_of(spark, BOOK_RULE, [{
        "Name": f"site {i}", "SiteDomain": f"s{i}.example.com", "TargetSiteUrl": "http://t.example.com/",
        "ListUrl": f"http://s{i}.example.com/list0.html",
        "ListUrlNextRule": r'(?<=<a rel="next" href=").*?(?=")',
        "ListRule": r'<li><a href="(?<url>.*?)">(?<title>.*?)</a></li>',
        "InfoRule": r"<h1>(?<title>.*?)</h1><b>(?<author>.*?)</b>",
        "ChapterListRule": r'<dd><a href="(?<url>.*?)">(?<title>.*?)</a></dd>',
        "ContentRule": r"<h2>(?<title>.*?)</h2><article>(?<content>[\s\S]*?)</article>",
        "NextChapterUrlRule": r'(?<=<a class="onward" href=").*?(?=")',
    } for i in range(SITES)])
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % SITES).alias("site"), F.floor(F.col("conv_id") / SITES).alias("n"), "conv_id", "turn", "text")
    books = turns.where("turn = 0")
    item = F.format_string('<li><a href="/book%d.html">book %d</a></li>', "conv_id", "conv_id")
    info = books.select(
        address("/book", F.col("conv_id").cast("string"), ".html").alias("url"),
        F.format_string('<h1>book %d</h1><b>nobody</b><dd><a href="/c/%d/0.html">turn 0</a></dd>', "conv_id", "conv_id")
        .alias("html"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("more"))
    onward = F.when(F.col("more"), F.format_string('<a class="onward" href="/c/%d/%d.html">', F.col("conv_id"),
                                                   F.col("turn") + 1))
    chapters = turns.join(following, ["conv_id", "turn"], "left").select(
        address("/c/", F.col("conv_id").cast("string"), "/", F.col("turn").cast("string"), ".html").alias("url"),
        F.concat(F.format_string("<h2>turn %d</h2><article>", "turn"), "text", F.lit("</article>"),
                 F.coalesce(onward, F.lit(""))).alias("html"))
    catalog = Catalog.create(spark, new_path(spark, "catalog"))
    harvest_books(catalog, rules, numbered([list_pages(books, item), info, chapters]), 1)
    saved = catalog.table("chapter").withColumnRenamed("id", "chapter_id").drop("batch")
    content = catalog.table("chapter_content").select("chapter_id", "content")
    return saved.join(content, "chapter_id").select("book_title", "title", "text_length", "content")


MOVIE_SQL = "'Movie ' || source_id || 'X'"
EPISODE_SQL = _strip(
    _strip(f"regexp_replace(lower(replace(file_name, {MOVIE_SQL}, '')), '{DOMAIN_SQL}', '', 'g')", EXTENSIONS),
    ["[", "]", "(", ")", "国语", "粤语", "dvd", "bd", "版", "-"])


@query(f"""
WITH {SOURCES_SQL},
m AS (SELECT source_id, regexp_extract_all(text, '(bdhd://|qvod://).*?(.rmvb|.rm|.avi|.mp4|.asf|.wmv)+', 0) AS l FROM s),
u AS (SELECT source_id, unnest(range(len(l))) AS pos, unnest(l) AS url FROM m),
k AS (SELECT *, CASE WHEN starts_with(url, 'bdhd') THEN 'baidu' ELSE 'qvod' END AS kind,
             string_split(url, '|')[3] AS file_name FROM u WHERE len(string_split(url, '|')) > 2),
c AS (SELECT source_id, pos, kind, url, {EPISODE_SQL} AS t FROM k),
e AS (SELECT source_id, pos, kind, url, {_numbered('t')} AS title FROM c)
SELECT {MOVIE_SQL} AS movie_title, kind, title, arg_min(url, pos) AS url, '剧情' AS class_name,
       '/u/MovieFace/' || dense_rank() OVER (ORDER BY {MOVIE_SQL}) || '.jpg' AS face_image
FROM e GROUP BY source_id, kind, title""")
def series_job(spark, sf_dir):
    """Four sites: lists of series, info and play pages, media files of 50 links on another host."""
    rules = rules_of(spark, SERIES_RULE, [{
        "Name": f"site {i}", "SiteName": "某影院", "ListPageUrl": f"http://s{i}.example.com/list0.html",
        "NextListRule": r'<a rel="next" href="(?<key>.*?)">',
        "ListInfoRule": r'<li><a href="(?<url>.*?)">(?<title>.*?)</a></li>',
        "InfoRule": r'<b>(?<class>.*?)</b><img src="(?<image>.*?)">《(?<title>.*?)》<i>(?<class>.*?)</i>',
        "BaiduAreaRule": r"<ul>(?<key>[\s\S]*?)</ul>",
        "BaiduDramaRule": r"<li><a href='(?<playurl>.*?)'>(?<title>.*?)</a></li>",
        "DramaPageBaiduRule": r'<script src="(?<source>.*?)"></script>', "SourceBaiduRule": "yes",
    } for i in range(SITES)])
    sources = sources_of(spark, sf_dir).select(
        (F.col("source_id") % SITES).alias("site"), F.floor(F.col("source_id") / SITES).alias("n"), "source_id", "text")
    item = F.format_string('<li><a href="/m%d.html">Movie %dX...</a></li>', "source_id", "source_id")
    info = sources.select(
        address("/m", F.col("source_id").cast("string"), ".html").alias("url"),
        F.format_string('<b>a</b><img src="/i.jpg">《Movie %dX》<i>剧情</i><ul><li><a href=\'/p%d.html\'>1</a></li>'
                        "<li><a href='/none.html'>2</a></li></ul>", "source_id", "source_id").alias("html"))
    play = sources.select(
        address("/p", F.col("source_id").cast("string"), ".html").alias("url"),
        F.format_string('<script src="http://media.example.com/%d.js"></script>', "source_id").alias("html"))
    files = sources.select(F.format_string("http://media.example.com/%d.js", "source_id").alias("url"),
                           F.col("text").alias("html"))
    catalog = Catalog.create(spark, new_path(spark, "catalog"))
    harvest_series(catalog, rules, numbered([list_pages(sources, item), info, play, files]), 1)
    series = catalog.table("series").select(F.col("id").alias("movie_id"), "class_name", "face_image")
    return catalog.table("episode").join(series, "movie_id").select(
        "movie_title", "kind", "title", "url", "class_name", "face_image")


@query(f"""
SELECT 'book ' || conv_id AS book_title, 'turn ' || turn AS title, CAST(length(text) AS INT) AS text_length,
       {sql_entities(sql_filter('text'))} AS content, turn + 1 AS place FROM conversations""")
def stream_catalog(spark, sf_dir):
    """Polled in three passes, with pages of all levels in each: what a pass misses a later one brings.

    ``place``: the chapter's place in its book by id, so that the order of the list is held across passes.
    """
    rules = rules_of(spark, BOOK_RULE, [{
        "Name": "site", "SiteDomain": "s0.example.com", "TargetSiteUrl": "http://t.example.com/",
        "ListUrl": "http://s0.example.com/list0.html", "ListUrlNextRule": r'(?<=<a rel="next" href=").*?(?=")',
        "ListRule": r'<li><a href="(?<url>.*?)">(?<title>.*?)</a></li>', "InfoRule": r"<h1>(?<title>.*?)</h1>",
        "ChapterListRule": r'<dd><a href="(?<url>.*?)">(?<title>.*?)</a></dd>',
        "ContentRule": r"<h2>(?<title>.*?)</h2><article>(?<content>[\s\S]*?)</article>",
    }])
    turns = table(spark, sf_dir, "conversations").select(F.lit(0).alias("site"), "conv_id", "turn", "text")
    books = turns.groupBy("site", "conv_id").agg(F.max("turn").alias("last")).withColumn("n", F.col("conv_id"))
    item = F.format_string('<li><a href="/book%d.html">book %d</a></li>', "conv_id", "conv_id")
    entry = F.transform(F.sequence(F.lit(0), "last"), lambda t: F.format_string(
        '<dd><a href="/c/%d/%d.html">turn %d</a></dd>', F.col("conv_id"), t, t))
    info = books.select(address("/book", F.col("conv_id").cast("string"), ".html").alias("url"),
                        F.concat(F.format_string("<h1>book %d</h1>", "conv_id"), F.array_join(entry, "")).alias("html"))
    chapters = turns.select(
        address("/c/", F.col("conv_id").cast("string"), "/", F.col("turn").cast("string"), ".html").alias("url"),
        F.concat(F.format_string("<h2>turn %d</h2><article>", "turn"), "text", F.lit("</article>")).alias("html"))
    landing = new_path(spark, "landing")
    crawl = numbered([list_pages(books, item), info, chapters])
    for n in range(3):
        crawl.where(F.pmod(F.xxhash64("url"), F.lit(3)) == n).repartition(1).write.mode("append").parquet(landing)
    catalog = Catalog.create(spark, new_path(spark, "catalog"))
    poll_books(catalog, rules, landing, new_path(spark, "poll"), files_per_batch=1).awaitTermination()
    saved = catalog.table("chapter").withColumnRenamed("id", "chapter_id").drop("batch")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_id")).cast("bigint")
    content = catalog.table("chapter_content").select("chapter_id", "content")
    return saved.withColumn("place", place).join(content, "chapter_id").select(
        "book_title", "title", "text_length", "content", "place")
