"""Queries: page chains, stitched texts and media source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.functions import text, titles
from gleanery.operators import chains, extract
from gleanery.plans.cleaning import sql_entities, sql_filter
from gleanery.plans.registry import query, table
from gleanery.schemas import with_defaults
from gleanery.session import spread

# Conversations as page chains: a page per turn, linked to the next turn.
NODE = "%d/%d"


def chain_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, seeds, edges) of the conversations."""
    turns = table(spark, sf_dir, "conversations")
    pages = turns.select("conv_id", "turn", F.format_string(NODE, "conv_id", "turn").alias("node"), "text")
    seeds = pages.where("turn = 0").select(F.col("conv_id").alias("seed"), "node")
    edges = pages.select("node", F.format_string(NODE, F.col("conv_id"), F.col("turn") + 1).alias("next"))
    # The last page of a chain links nowhere.
    edges = edges.join(pages.select(F.col("node").alias("next")), "next", "left_semi")
    return pages, seeds, edges


WALK_SQL = """
WITH RECURSIVE w(conv_id, turn, step) AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, step + 1 FROM w JOIN conversations c
  ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)"""


@query(f"{WALK_SQL} SELECT conv_id AS seed, conv_id || '/' || turn AS node, step FROM w")
def walk_list(spark, sf_dir):
    _, seeds, edges = chain_of(spark, sf_dir)
    return chains.walk(seeds, edges)


@query(f"""{WALK_SQL} SELECT w.conv_id, w.step, substring(text, 1, 40) AS title,
       CAST(length(text) AS INT) AS text_length, text AS content FROM w JOIN conversations USING (conv_id, turn)""")
def walk_chapters(spark, sf_dir):
    pages, seeds, edges = chain_of(spark, sf_dir)
    reached = chains.walk(seeds, edges)
    return reached.join(pages, "node").select(
        F.col("seed").alias("conv_id"), "step", F.substring("text", 1, 40).alias("title"),
        F.length("text").alias("text_length"), F.col("text").alias("content"))


@query(f"""{WALK_SQL} SELECT conv_id, count(*) AS parts, string_agg(text, '' ORDER BY step) AS content
FROM w JOIN conversations USING (conv_id, turn) GROUP BY ALL""")
def stitch_content(spark, sf_dir):
    pages, seeds, edges = chain_of(spark, sf_dir)
    parts = chains.walk(seeds, edges).join(pages.select("node", "text"), "node")
    return chains.stitch(parts.withColumnRenamed("seed", "conv_id"), ["conv_id"])


@query(f"""
WITH t AS (SELECT doc_id, '<p>&copy; ' || text || '</p>' AS text FROM documents)
SELECT doc_id AS chapter_id, 'ch ' || doc_id AS title, {sql_entities(sql_filter('text'))} AS content,
       false AS is_image_chapter, false AS is_temp FROM t""")
def chapter_content(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("chapter_id"), F.concat(F.lit("ch "), F.col("doc_id")).alias("title"),
        F.concat(F.lit("<p>&copy; "), "text", F.lit("</p>")).alias("content"))
    cleaned = text.content_filter(docs, "content").withColumn("content", text.html_decode(F.col("content")))
    return with_defaults(cleaned, "chapter_content")


@query("""
SELECT a.conv_id, a.turn, coalesce(b.text, a.text) AS html FROM conversations a
LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def chapter_list_source(spark, sf_dir):
    pages, _, edges = chain_of(spark, sf_dir)
    html = pages.select("node", F.col("text").alias("html"))
    linked = edges.join(html.withColumnRenamed("node", "next"), "next").select("node", "html")
    own = pages.select("conv_id", "turn", "node", F.col("text").alias("html"))
    return chains.own_or_linked(own, linked, "node").select("conv_id", "turn", "html")


# Source files of up to 50 links, in the order of the parts.
SOURCE_SIZE = 50
LINK_SQL = """
  CASE WHEN p_partkey % 2 = 0 THEN 'bdhd://' ELSE 'qvod://' END || p_partkey * 7 || '|' || p_partkey ||
  CASE WHEN p_partkey % 19 = 0 THEN '' ELSE '|' || CASE p_partkey % 4 WHEN 0 THEN '[www.x.com]' WHEN 1 THEN '国语_' ELSE '' END
    || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '-' END || p_partkey % 100 END ||
  CASE p_partkey % 3 WHEN 0 THEN '.rmvb' WHEN 1 THEN '.mp4' ELSE '.AVI.avi' END"""
SOURCES_SQL = f"""
s AS (SELECT p_partkey // {SOURCE_SIZE} AS source_id, min(p_name) AS series_title,
             string_agg({LINK_SQL}, '#' ORDER BY p_partkey) || '#' AS text
      FROM part GROUP BY ALL)"""
MEDIA_SQL = r"(bdhd://|qvod://).*?(.rmvb|.rm|.avi|.mp4|.asf|.wmv)+"
LINKS_SQL = f"""{SOURCES_SQL},
m AS (SELECT source_id, series_title, regexp_extract_all(text, '{MEDIA_SQL}', 0) AS l FROM s),
u AS (SELECT source_id, series_title, unnest(range(len(l))) AS pos, unnest(l) AS url FROM m),
k AS (SELECT *, CASE WHEN starts_with(url, 'bdhd') THEN 'baidu' ELSE 'qvod' END AS kind,
             CASE WHEN len(string_split(url, '|')) > 2 THEN string_split(url, '|')[3] END AS file_name FROM u)"""


def sources_of(spark, sf_dir) -> DataFrame:
    """(source_id, series_title, text): media links of parts, 50 in a file."""
    parts = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / SOURCE_SIZE).alias("source_id"), "p_partkey", "p_name", F.expr(LINK_SQL).alias("link"))
    links = F.array_sort(F.collect_list(F.struct("p_partkey", "link")))
    return parts.groupBy("source_id").agg(F.min("p_name").alias("series_title"), links.alias("l")).select(
        "source_id", "series_title", F.concat(F.array_join(F.col("l.link"), "#"), F.lit("#")).alias("text"))


def source_links(spark, sf_dir) -> DataFrame:
    return extract.media_links(sources_of(spark, sf_dir), ["source_id", "series_title"],
                               text.media_decode(F.col("text")))


@query(f"WITH {LINKS_SQL} SELECT source_id, pos, url, kind, file_name FROM k")
def media_links(spark, sf_dir):
    return source_links(spark, sf_dir).drop("series_title")


def _strip(v: str, strings) -> str:
    for s in strings:
        v = f"replace({v}, '{s}', '')"
    return v


def _numbered(v: str) -> str:
    return f"CASE WHEN regexp_full_match({v}, '[0-9]+') THEN '第' || {v} || '集' ELSE {v} END"


DOMAIN_SQL = r"[a-zA-Z0-9\.]+\.(com|net|org|co|cn|us|hk|info|gov)"
EXTENSIONS = [".rmvb", ".rm", ".avi", ".mp4", ".asf", ".wmv", " ", ".", "_"]
BASIC_SQL = _strip(f"regexp_replace(lower(replace(file_name, series_title, '')), '{DOMAIN_SQL}', '', 'g')", EXTENSIONS)
BARE_SERIES = _strip("series_title", ["(", ")", "国语", "粤语", "版"])
FULL_SQL = _strip(BASIC_SQL.replace("series_title", BARE_SERIES),
                  ["[", "]", "(", ")", "国语", "粤语", "dvd", "bd", "版", "-"])


@query(f"""WITH {LINKS_SQL}, c AS (SELECT source_id, pos, {FULL_SQL} AS t FROM k WHERE file_name IS NOT NULL)
SELECT source_id, pos, {_numbered('t')} AS title FROM c""")
def episode_title(spark, sf_dir):
    links = source_links(spark, sf_dir).where("file_name is not null")
    return links.select("source_id", "pos",
                        titles.episode_title(F.col("file_name"), F.col("series_title")).alias("title"))


@query(f"""WITH {LINKS_SQL}, c AS (SELECT source_id, pos, {BASIC_SQL} AS t FROM k WHERE file_name IS NOT NULL)
SELECT source_id, pos, {_numbered('t')} AS title FROM c""")
def episode_title_basic(spark, sf_dir):
    links = source_links(spark, sf_dir).where("file_name is not null")
    return links.select("source_id", "pos",
                        titles.episode_title_basic(F.col("file_name"), F.col("series_title")).alias("title"))


@query(f"WITH {LINKS_SQL} SELECT source_id, count(*) AS n_resources FROM k GROUP BY ALL")
def resource_count(spark, sf_dir):
    return source_links(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n_resources"))


@query(f"""WITH {LINKS_SQL}, c AS (SELECT source_id, pos, kind, url, {FULL_SQL} AS t FROM k WHERE file_name IS NOT NULL)
SELECT source_id, {_numbered('t')} AS title, pos, kind, url FROM c ORDER BY ALL""")
def episodes_sorted(spark, sf_dir):
    links = source_links(spark, sf_dir).where("file_name is not null")
    title = titles.episode_title(F.col("file_name"), F.col("series_title")).alias("title")
    return links.select("source_id", title, "pos", "kind", "url").orderBy("source_id", "title", "pos")
