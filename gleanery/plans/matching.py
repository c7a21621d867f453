"""Queries: harvested rows against the stored catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.text import status_code, to_int
from gleanery.functions.urls import host, resolve
from gleanery.operators import extract, incremental, lookup
from gleanery.plans.extraction import LIST_RULE, host_rules, pages_of, rule_patterns
from gleanery.plans.registry import HOST_SQL, query, table
from gleanery.schemas import with_defaults
from gleanery.session import new_path, write_out
from gleanery.sources import wordlists
from gleanery.sources.catalog import Catalog
from gleanery.sources.pages import rule_pages, with_host
from gleanery.sources.rules import BOOK, compile_rules

BLACKLIST_FILE = "casino-win\r\ncheap-pills\nads-track\n\nfree-bets"
SITE = r"([^.]+)\.example\.[a-z]+$"


@query(rf"""
SELECT page_id, regexp_extract({HOST_SQL}, '{SITE}', 1) AS title FROM pages
WHERE regexp_extract({HOST_SQL}, '{SITE}', 1) NOT IN ('casino-win', 'cheap-pills', 'ads-track', '', 'free-bets')""")
def blacklist_anti(spark, sf_dir):
    lines = wordlists.split_lines(spark.createDataFrame([(BLACKLIST_FILE,)], "value string"), "value")
    titled = pages_of(spark, sf_dir).select(
        "page_id", F.regexp_extract(host(F.col("url")), SITE, 1).alias("title"))
    return lookup.exclude(titled, wordlists.blacklist(lines), "title", ["page_id"])


@query("""
WITH h AS (SELECT doc_id, source AS title, CASE WHEN lang = 'en' THEN '' ELSE lang END AS author FROM documents),
s AS (SELECT title, author, min(doc_id) AS stored_id FROM h WHERE title < 'src3' AND author <> 'de' GROUP BY ALL)
SELECT doc_id, title, author, stored_id FROM h LEFT JOIN s USING (title, author)""")
def book_lookup(spark, sf_dir):
    harvested = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("title"), F.when(F.col("lang") != "en", F.col("lang")).alias("author"))
    stored = harvested.where("title < 'src3' and coalesce(author, '') <> 'de'").withColumnRenamed("doc_id", "id")
    return lookup.first_stored(harvested, stored, ["title", "author"], ["doc_id"])


@query("""
WITH c AS (SELECT lang AS class_name, min(doc_id) AS class_id FROM documents WHERE lang <> 'de' GROUP BY ALL)
SELECT doc_id, lang AS class_name, class_id FROM documents LEFT JOIN c ON lang = class_name""")
def class_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("class_name"))
    classes = docs.where("class_name <> 'de'").withColumnRenamed("doc_id", "id")
    return incremental.attach_class(docs, classes, ["doc_id"])


@query("""
WITH s AS (SELECT p_name AS title, min(p_partkey) AS stored_id FROM part WHERE p_name < 'm' GROUP BY ALL)
SELECT p_partkey, p_name AS title, stored_id FROM part LEFT JOIN s ON p_name = title""")
def series_lookup_exact(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    stored = parts.where("title < 'm'").withColumnRenamed("p_partkey", "id")
    return lookup.first_stored(parts, stored, ["title"], ["p_partkey"])


@query("""
WITH h AS (SELECT DISTINCT split_part(p_name, ' ', 2) || '...' AS title FROM part
           UNION SELECT DISTINCT substring(p_name, 2, 5) || '.' FROM part),
m AS (SELECT title, rtrim(title, '.') AS short_title, min(p_partkey) AS id FROM h
      JOIN part ON contains(p_name, rtrim(title, '.')) GROUP BY ALL)
SELECT title, short_title, id, p_name AS stored_title FROM m JOIN part ON id = p_partkey""")
def contains_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    words = parts.select(F.concat(F.split("p_name", " ")[1], F.lit("...")).alias("title"))
    pieces = parts.select(F.concat(F.substring("p_name", 2, 5), F.lit(".")).alias("title"))
    stored = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return lookup.contains_match(words.unionByName(pieces), stored)


EPISODES_SQL = """
e AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'baidu' ELSE 'qvod' END AS kind,
             CAST(p_size AS BIGINT) AS movie_id, p_name || ' ' || p_partkey % 10 AS title,
             p_type = 'ECONOMY' AS stored FROM part),
known AS (SELECT DISTINCT kind, movie_id, title FROM e WHERE stored),
fresh AS (SELECT kind, movie_id, title, min(pos) AS pos FROM e
          WHERE (kind, movie_id, title) NOT IN (SELECT (kind, movie_id, title) FROM known) GROUP BY ALL)"""


def episodes_of(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_partkey") % 2 == 0, "baidu").otherwise("qvod").alias("kind"),
        F.col("p_size").cast("long").alias("movie_id"),
        F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 10).cast("string")).alias("title"),
        (F.col("p_type") == "ECONOMY").alias("stored"),
    )


EPISODE_KEY = ["kind", "movie_id", "title"]


@query(f"WITH {EPISODES_SQL} SELECT kind, movie_id, title, pos FROM fresh")
def new_episodes(spark, sf_dir):
    candidates = episodes_of(spark, sf_dir)
    return lookup.new_rows(candidates.drop("stored"), candidates.where("stored"), EPISODE_KEY, ["pos"])


@query(f"""
WITH {EPISODES_SQL},
k AS (SELECT *, row_number() OVER (ORDER BY kind, movie_id, title) AS id FROM known),
f AS (SELECT kind, movie_id, title,
             row_number() OVER (ORDER BY kind, movie_id, title) + (SELECT count(*) FROM known) AS id FROM fresh)
SELECT kind, movie_id, title, id, true AS enable FROM k
UNION ALL SELECT kind, movie_id, title, id, true FROM f""")
def append_new_episodes(spark, sf_dir):
    candidates = episodes_of(spark, sf_dir)
    catalog = Catalog.create(spark, new_path(spark, "catalog"), ["episode"])
    for batch, rows in enumerate([candidates.where("stored"), candidates], start=1):
        stored = catalog.table("episode", before=batch)
        catalog.commit(batch, {"episode": incremental.get_or_create(rows, stored, EPISODE_KEY, "episode",
                                                                    order=["pos"])})
    return catalog.table("episode").select(*EPISODE_KEY, "id", "enable")


@query(f"WITH {EPISODES_SQL} SELECT kind, movie_id, title, pos FROM e")
def episode_route(spark, sf_dir):
    path = new_path(spark, "routed")
    episodes_of(spark, sf_dir).drop("stored").write.partitionBy("kind").parquet(path)
    stored = spark.read.schema("movie_id bigint, title string, pos bigint, kind string").parquet(path)
    legs = incremental.route_by_kind(stored)
    return legs["baidu"].unionByName(legs["qvod"])


@query("""
SELECT a.conv_id, a.turn, b.turn AS to_turn, b.text AS to_text
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def follow_links(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")

    def address(turn):
        return F.format_string("HTTP://C%d.example.com:80/t/../%d#x", "conv_id", turn)

    pages = turns.select(F.format_string("http://c%d.example.com/%d", "conv_id", "turn").alias("url"), "turn", "text")
    links = turns.select("conv_id", "turn", address(F.col("turn") + 1).alias("link"))
    followed = lookup.follow(links, pages, ["conv_id", "turn"])
    return followed.select("conv_id", "turn", "to_turn", "to_text")


@query("""
SELECT d.doc_id, source AS title, lang AS author,
  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(n_chars AS INT) END AS length,
  CAST(CASE WHEN quality = 1 THEN 0 ELSE 1 END AS SMALLINT) AS status,
  CAST(0 AS BIGINT) AS last_chapter_id, '' AS last_chapter_title, true AS enable, CAST(0 AS BIGINT) AS click_count
FROM documents d LEFT JOIN labels USING (doc_id)""")
def book_record(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    raw = docs.select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("author"),
        F.when(F.col("doc_id") % 7 == 0, "12a").otherwise(F.col("n_chars").cast("string")).alias("length"),
    ).join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "连载中").otherwise("完本")
    typed = raw.withColumns({"id": F.col("doc_id"), "length": to_int(F.col("length")), "status": status_code(status)})
    return with_defaults(typed, "book").select(
        F.col("id").alias("doc_id"), "title", "author", "length", "status", "last_chapter_id", "last_chapter_title",
        "enable", "click_count")


@query("""
WITH b AS (SELECT CAST(substring(source, 4) AS BIGINT) AS book_id, source AS book_title, min(lang) AS class_name
           FROM documents GROUP BY ALL)
SELECT doc_id AS id, book_id, book_title, class_name, 'ch ' || doc_id AS title,
       CAST(length(text) AS INT) AS text_length, CAST(0 AS INT) AS chapter_index, true AS is_free
FROM documents JOIN b ON source = book_title""")
def chapter_record(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 9).cast("long").alias("book_id"),
        F.concat(F.lit("ch "), F.col("doc_id")).alias("title"), F.length("text").alias("text_length"),
        "source", "lang")
    books = docs.groupBy("book_id", F.col("source").alias("book_title")).agg(F.min("lang").alias("class_name"))
    rows = lookup.attach_parent(docs.drop("source", "lang"), books, "book_id", ["id"])
    return with_defaults(rows, "chapter").select(
        "id", "book_id", "book_title", "class_name", "title", "text_length", "chapter_index", "is_free")


@query(f"""
WITH l AS (
  WITH m AS (SELECT page_id, {HOST_SQL} AS host, regexp_extract_all(html, '<a href="(.*?)">(.*?)</a>', 1) AS u,
                    regexp_extract(html, '<html lang="(.*?)">', 1) AS class_name FROM pages)
  SELECT page_id, host, class_name, unnest(u) AS url FROM m),
k AS (SELECT * FROM l WHERE regexp_extract(host, '{SITE}', 1) NOT IN
        ('casino-win', 'cheap-pills', 'ads-track', '', 'free-bets')),
c AS (SELECT '其他' AS class_name, 1 AS class_id UNION ALL
      SELECT class_name, 1 + row_number() OVER (ORDER BY class_name) FROM (SELECT DISTINCT class_name FROM k))
SELECT class_id, class_name, host, count(*) AS n_links, count(DISTINCT 'x' || url) AS n_targets
FROM k JOIN c USING (class_name) GROUP BY ALL""")
def harvest_overview(spark, sf_dir):
    """From rules and pages to links per class and site: the flow end to end."""
    pages = with_host(pages_of(spark, sf_dir))
    rules = host_rules(pages).withColumn("ListRule", F.lit(LIST_RULE))
    rules = compile_rules(rules.select("SiteDomain", *rule_patterns()), BOOK)
    rules = rules.where(extract.is_enabled(F.col("ListRule"))).select(
        F.col("SiteDomain").alias("host"), "ListRule", "InfoRule")
    joined = rule_pages(pages, rules)
    info = extract.first_match(F.col("html"), F.col("InfoRule"), ["class"])["class"]
    joined = joined.withColumn("class_name", info)
    links = extract.explode_matches(joined.withColumnRenamed("url", "base"), ["page_id", "host", "base", "class_name"],
                                    extract.all_matches(F.col("html"), F.col("ListRule"), ["url", "title"]))
    links = links.withColumn("target", resolve(F.col("url"), F.col("base")))
    links = links.withColumn("site", F.regexp_extract("host", SITE, 1))
    listed = wordlists.blacklist(
        wordlists.split_lines(spark.createDataFrame([(BLACKLIST_FILE,)], "value string"), "value"))
    kept = lookup.exclude(links, listed.withColumnRenamed("title", "site"), "site", ["page_id", "pos"])

    targets = F.countDistinct(F.regexp_replace("target", "^[a-z]+://", ""))
    counted = write_out(kept.groupBy("class_name", "host").agg(
        F.count("*").alias("n_links"), targets.alias("n_targets")), "counted")
    seed = spark.createDataFrame([(1, "其他", 0, 4)], "id bigint, class_name string, parent_id bigint, model_id int")
    fresh = incremental.new_classes(counted.select("class_name"), seed, 4)
    classes = seed.unionByName(fresh)
    return incremental.attach_class(counted, classes, ["class_name", "host"]).select(
        "class_id", "class_name", "host", "n_links", "n_targets")
