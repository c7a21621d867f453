"""Queries: from pages to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.functions.text import first_filled, strip_site_name, strip_tags
from gleanery.functions.titles import standard_title
from gleanery.functions.urls import host, resolve
from gleanery.operators import extract, incremental, quarantine
from gleanery.plans.registry import HOST_SQL, query, sql_resolve, table
from gleanery.sources.pages import rule_pages as join_rules, with_host
from gleanery.sources.rules import BOOK, PATTERNS, compile_rules

LIST_RULE = r'<a href="(?<url>.*?)">(?<title>.*?)</a>'
INFO_RULE = r'<html lang="(?<class>.*?)">[\s\S]*?<title>(?<title>.*?)</title>[\s\S]*?<h1>(?<heading>.*?)</h1>'
CONTENT_RULE = r"<article>(?<content>[\s\S]*?)</article>"
REGION_RULE = r"<nav>(?<key>[\s\S]*?)</nav>"
PARAGRAPH_RULE = r"<p>(?<title>.*?)</p>"
NEXT_RULE = r'<a href="(?<key>.*?)">'
SOURCE_RULE = r"<footer>&copy; (?<source>.*?) &middot;"

LIST_SQL = r'<a href="(.*?)">(.*?)</a>'
INFO_SQL = r'<html lang="(.*?)">[\s\S]*?<title>(.*?)</title>[\s\S]*?<h1>(.*?)</h1>'


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def host_rules(pages: DataFrame) -> DataFrame:
    """One book rule per site of the corpus.

    The list rule depends on the length of the host: one kind of sites lists
    links, one lists paragraphs, one has no list rule.
    """
    hosts = with_host(pages).select("host").distinct()
    kind = F.length("host") % 3
    return hosts.select(
        F.col("host").alias("Name"), F.col("host").alias("SiteName"), F.col("host").alias("SiteDomain"),
        F.lit("utf-8").alias("CharSet"), F.concat(F.lit("http://"), F.col("host"), F.lit("/")).alias("ListUrl"),
        F.when(kind == 0, LIST_RULE).when(kind == 1, PARAGRAPH_RULE).otherwise("").alias("ListRule"),
        F.lit(INFO_RULE).alias("InfoRule"), F.lit(CONTENT_RULE).alias("ContentRule"),
        F.lit(120).alias("FaceWidth"), F.lit(142).alias("FaceHeight"),
    )


def rule_patterns() -> list[Column]:
    """All pattern columns of ``host_rules``, empty where it has none."""
    return [F.col(c) if c in ("ListRule", "InfoRule", "ContentRule") else F.lit("").alias(c) for c in PATTERNS[BOOK]]


@query(f"SELECT page_id, {HOST_SQL} AS host, length(html) AS n_chars FROM pages")
def page_scan(spark, sf_dir):
    return with_host(pages_of(spark, sf_dir)).select("page_id", "host", F.length("html").cast("long").alias("n_chars"))


@query(f"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '{LIST_SQL}', 1) AS u,
                  regexp_extract_all(html, '{LIST_SQL}', 2) AS t FROM pages)
SELECT page_id, unnest(range(len(u))) AS pos, unnest(u) AS url, unnest(t) AS title FROM m""")
def extract_links(spark, sf_dir):
    pages = pages_of(spark, sf_dir).select("page_id", "html")
    return extract.explode_matches(pages, ["page_id"],
                                   extract.all_matches(F.col("html"), LIST_RULE, ["url", "title"]))


@query(f"""
SELECT page_id, regexp_matches(html, '{INFO_SQL}') AS matched, regexp_extract(html, '{INFO_SQL}', 1) AS class,
       regexp_extract(html, '{INFO_SQL}', 2) AS title, regexp_extract(html, '{INFO_SQL}', 3) AS heading,
       '' AS author
FROM pages""")
def extract_info(spark, sf_dir):
    info = extract.first_match(F.col("html"), INFO_RULE, ["class", "title", "heading", "author"])
    return pages_of(spark, sf_dir).select("page_id", info.alias("i")).select("page_id", "i.*").drop("whole")


@query(f"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '{LIST_SQL}', 1) AS u,
                  regexp_extract_all(html, '{LIST_SQL}', 2) AS t FROM pages)
SELECT page_id, unnest(range(len(u))) AS pos, unnest(u) AS url, unnest(t) AS title, '' AS class, '' AS location,
       '' AS publicyear, '' AS actors, '' AS director, '' AS intro, '' AS info, '' AS image
FROM m""")
def list_records(spark, sf_dir):
    return extract.list_records(pages_of(spark, sf_dir), ["page_id"], F.col("html"), LIST_RULE)


@query(rf"""
WITH r AS (SELECT page_id, regexp_extract(html, '<nav>([\s\S]*?)</nav>', 1) AS area FROM pages),
m AS (SELECT page_id, regexp_extract_all(area, '{LIST_SQL}', 1) AS u,
             regexp_extract_all(area, '{LIST_SQL}', 2) AS t FROM r)
SELECT page_id, unnest(range(len(u))) AS pos, unnest(u) AS url, unnest(t) AS title FROM m""")
def extract_region_items(spark, sf_dir):
    items = extract.region_matches(F.col("html"), REGION_RULE, LIST_RULE, ["url", "title"])
    return extract.explode_matches(pages_of(spark, sf_dir), ["page_id"], items)


@query("SELECT page_id, url FROM pages WHERE regexp_matches(html, '<p>.*?</p>')")
def match_predicate(spark, sf_dir):
    return pages_of(spark, sf_dir).where(extract.is_match(F.col("html"), PARAGRAPH_RULE)).select("page_id", "url")


@query("""
SELECT 'content' AS step, 'paragraph' AS rule, url, '' AS title, 'no_match' AS reason, CAST(1 AS INT) AS attempts
FROM pages WHERE NOT regexp_matches(html, '<p>.*?</p>')""", name="quarantine")
def quarantine_rows(spark, sf_dir):
    reason = F.when(~extract.is_match(F.col("html"), PARAGRAPH_RULE), "no_match")
    _, bad = quarantine.split(pages_of(spark, sf_dir), reason)
    bad = bad.withColumns({"rule": F.lit("paragraph"), "title": F.lit("")})
    return quarantine.as_quarantine(bad, "content")


@query(f"""
SELECT {HOST_SQL} AS rule, count(*) AS n_pages FROM pages
WHERE length({HOST_SQL}) % 3 <> 2 GROUP BY ALL""")
def rule_guard(spark, sf_dir):
    pages = with_host(pages_of(spark, sf_dir))
    rules = compile_rules(host_rules(pages).select("SiteDomain", *rule_patterns()), BOOK)
    active = rules.where(extract.is_enabled(F.col("ListRule"))).select(F.col("SiteDomain").alias("host"))
    joined = join_rules(pages.select("page_id", "host"), active)
    return joined.groupBy(F.col("host").alias("rule")).agg(F.count("*").alias("n_pages"))


@query(rf"""
WITH p AS (SELECT page_id, {HOST_SQL} AS rule, html FROM pages),
m AS (SELECT page_id, rule,
        CASE length(rule) % 3 WHEN 0 THEN regexp_extract_all(html, '{LIST_SQL}', 1)
                              WHEN 1 THEN list_transform(regexp_extract_all(html, '<p>(.*?)</p>', 1), lambda x: '')
                              ELSE [] END AS u,
        CASE length(rule) % 3 WHEN 0 THEN regexp_extract_all(html, '{LIST_SQL}', 2)
                              WHEN 1 THEN regexp_extract_all(html, '<p>(.*?)</p>', 1)
                              ELSE [] END AS t
      FROM p)
SELECT rule, page_id, unnest(range(len(u))) AS pos, unnest(u) AS url, unnest(t) AS title FROM m""")
def rule_pages(spark, sf_dir):
    pages = with_host(pages_of(spark, sf_dir))
    rules = compile_rules(host_rules(pages).select("SiteDomain", *rule_patterns()), BOOK)
    joined = join_rules(pages, rules.select(F.col("SiteDomain").alias("host"), "ListRule"))
    matches = extract.all_matches(F.col("html"), F.col("ListRule"), ["url", "title"])
    return extract.explode_matches(joined, ["host", "page_id"], matches).withColumnRenamed("host", "rule")


@query(f"""
WITH k AS (SELECT page_id, url, regexp_extract(html, '<a href="(.*?)">', 1) AS key FROM pages)
SELECT page_id, CASE WHEN key <> '' THEN {sql_resolve('key', 'url')} END AS next_url FROM k""")
def next_link(spark, sf_dir):
    link = extract.next_link(F.col("html"), NEXT_RULE, F.col("url"))
    return pages_of(spark, sf_dir).select("page_id", link.alias("next_url"))


VARIANTS = ["", "x/y.html", "//h.example/z", "http://a.example/b", "?q=1", "#top"]


@query(f"""
WITH m AS (SELECT page_id, url AS base, unnest(range(len(l))) AS pos, unnest(l) AS link
           FROM (SELECT page_id, url, regexp_extract_all(html, '{LIST_SQL}', 1) AS l FROM pages)),
v AS (SELECT page_id, pos, base, v.i AS variant, CASE v.s WHEN '' THEN link ELSE v.s END AS link
      FROM m, (VALUES {', '.join(f"({i}, '{v}')" for i, v in enumerate(VARIANTS))}) v(i, s))
SELECT page_id, pos, variant, link, {sql_resolve('link', 'base')} AS resolved FROM v""")
def resolve_links(spark, sf_dir):
    links = extract.explode_matches(
        pages_of(spark, sf_dir).withColumnRenamed("url", "base"), ["page_id", "base"],
        extract.all_matches(F.col("html"), LIST_RULE, ["url"]))
    shapes = F.array(*[F.when(F.lit(v) == "", F.col("url")).otherwise(F.lit(v)) for v in VARIANTS])
    links = links.select("page_id", "pos", "base", F.posexplode(shapes).alias("variant", "link"))
    return links.select("page_id", "pos", "variant", "link", resolve(F.col("link"), F.col("base")).alias("resolved"))


@query("""
SELECT page_id, coalesce(nullif(regexp_extract(html, '<meta name="class" content="(.*?)">', 1), ''),
  nullif(CASE WHEN page_id % 3 <> 0 THEN regexp_extract(html, '<html lang="(.*?)">', 1) ELSE '' END, ''),
  '其他') AS class FROM pages""")
def default_chain(spark, sf_dir):
    meta = extract.first_match(F.col("html"), r'<meta name="class" content="(?<class>.*?)">', ["class"])["class"]
    lang = extract.first_match(F.col("html"), r'<html lang="(?<class>.*?)">', ["class"])["class"]
    lang = F.when(F.col("page_id") % 3 != 0, lang).otherwise(F.lit(""))
    return pages_of(spark, sf_dir).select("page_id", first_filled(meta, lang, "其他").alias("class"))


@query(f"""
SELECT page_id, replace(regexp_extract(html, '<footer>([\\s\\S]*?)</footer>', 1), {HOST_SQL}, '') AS text
FROM pages""", name="strip_site_name")
def strip_site(spark, sf_dir):
    footer = extract.first_match(F.col("html"), r"<footer>(?<text>[\s\S]*?)</footer>", ["text"])["text"]
    return pages_of(spark, sf_dir).select("page_id", strip_site_name(footer, host(F.col("url"))).alias("text"))


@query(r"""
SELECT page_id, regexp_replace(regexp_extract(html, '<article>([\s\S]*?)</article>', 1), '<[^>]*>', '', 'g') AS text
FROM pages""", name="strip_tags")
def strip_markup(spark, sf_dir):
    content = extract.first_match(F.col("html"), CONTENT_RULE, ["content"])["content"]
    return pages_of(spark, sf_dir).select("page_id", strip_tags(content).alias("text"))


@query(r"""
SELECT page_id, replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1) || ':|a//b?*', '/{2,}', '/', 'g'),
  ':', '_'), '>', ''), '<', ''), '*', ''), '?', ''), '|', '_') AS title FROM pages""", name="standard_title")
def standard_titles(spark, sf_dir):
    heading = extract.first_match(F.col("html"), r"<h1>(?<title>.*?)</h1>", ["title"])["title"]
    return pages_of(spark, sf_dir).select(
        "page_id", standard_title(F.concat(heading, F.lit(":|a//b?*"))).alias("title"))


@query(f"""
WITH p AS (SELECT page_id, url AS base,
  CASE WHEN page_id % 2 = 0 THEN html ELSE replace(html, '<a href', '<b href') END AS html FROM pages),
d AS (SELECT page_id, base, regexp_extract(html, '{LIST_SQL}', 1) AS u, regexp_extract(html, '{LIST_SQL}', 2) AS t,
  regexp_extract(html, '<footer>&copy; (.*?) &middot;', 1) AS s FROM p)
SELECT page_id, CASE WHEN u <> '' THEN 'direct' ELSE 'source' END AS leg,
  CASE WHEN u <> '' THEN t ELSE '' END AS page_title,
  CASE WHEN u <> '' THEN u ELSE {sql_resolve('s', 'base')} END AS url
FROM d WHERE u <> '' OR s <> ''""")
def play_page_branch(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    html = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(
        F.replace(F.col("html"), F.lit("<a href"), F.lit("<b href")))
    return extract.play_page_links(pages.withColumn("html", html), ["page_id"], F.col("html"), F.col("url"),
                                   LIST_RULE, SOURCE_RULE)


@query(f"""
WITH k AS (SELECT page_id AS id, url, regexp_extract(html, '<a href="(.*?)">', 1) AS key FROM pages)
SELECT id, {sql_resolve('key', 'url')} AS image_url, '/u/MovieFace/' || id || '.jpg' AS path
FROM k WHERE key <> ''""")
def cover_worklist(spark, sf_dir):
    link = extract.next_link(F.col("html"), NEXT_RULE, F.col("url"))
    return incremental.cover_worklist(
        pages_of(spark, sf_dir).select(F.col("page_id").alias("id"), link.alias("image_url")))
