"""Queries: rule files, raw pages and polled folders, all derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import clock
from gleanery.operators import lookup, quarantine
from gleanery.plans.extraction import INFO_RULE, LIST_RULE, PARAGRAPH_RULE, host_rules, pages_of
from gleanery.plans.registry import HOST_SQL, query, sql_text, table
from gleanery.schemas import with_defaults
from gleanery.session import new_path
from gleanery.sources import pages as page_source
from gleanery.sources.catalog import Catalog
from gleanery.sources.rules import BOOK, read_rules, write_rules
from gleanery.streaming.poll import page_stream, poll

RULES_SQL = f"""
SELECT DISTINCT {HOST_SQL} AS "Name", 'http://' || {HOST_SQL} || '/' AS "ListUrl",
  CASE length({HOST_SQL}) % 3 WHEN 0 THEN {sql_text(LIST_RULE)} WHEN 1 THEN {sql_text(PARAGRAPH_RULE)} ELSE '' END
    AS "ListRule",
  {sql_text(INFO_RULE)} AS "InfoRule", CAST(120 AS INT) AS "FaceWidth", '' AS "SearchUrl"
FROM pages"""
RULE_COLUMNS = ["Name", "ListUrl", "ListRule", "InfoRule", "FaceWidth", "SearchUrl"]


@query(RULES_SQL)
def rule_scan(spark, sf_dir):
    path = new_path(spark, "rules")
    write_rules(host_rules(pages_of(spark, sf_dir)), path, BOOK)
    return read_rules(spark, path, BOOK, glob="*").select(*RULE_COLUMNS)


@query(RULES_SQL)
def rule_roundtrip(spark, sf_dir):
    first, second = new_path(spark, "rules"), new_path(spark, "rules")
    write_rules(host_rules(pages_of(spark, sf_dir)), first, BOOK)
    write_rules(read_rules(spark, first, BOOK, glob="*"), second, BOOK)
    return read_rules(spark, second, BOOK, glob="*").select(*RULE_COLUMNS)


@query("""
SELECT page_id, CASE WHEN page_id % 11 = 5 THEN 'x-unheard-of' WHEN page_id % 3 = 0 THEN 'utf-8'
                     WHEN page_id % 3 = 1 THEN 'utf-16be' ELSE 'windows-1252' END AS charset,
       CASE WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 6 = 0 THEN html || chr(65533) ELSE html END AS html
FROM pages""")
def page_decode(spark, sf_dir):
    """Pages in three charsets; every second page in UTF-8 ends in a stray byte, some charsets are unknown."""
    charset = F.when(F.col("page_id") % 11 == 5, "x-unheard-of").when(F.col("page_id") % 3 == 0, "utf-8").when(
        F.col("page_id") % 3 == 1, "utf-16be").otherwise("windows-1252")
    # The letters of the pages have the same bytes in Latin-1 and windows-1252.
    utf8 = F.encode("html", "UTF-8")
    stray = F.concat(utf8, F.unhex(F.lit("FF")))
    content = (F.when(charset == "utf-8", F.when(F.col("page_id") % 6 == 0, stray).otherwise(utf8))
               .when(charset == "utf-16be", F.encode("html", "UTF-16BE")).otherwise(F.encode("html", "ISO-8859-1")))
    raw = pages_of(spark, sf_dir).select("page_id", charset.alias("charset"), content.alias("content"))
    return page_source.decode_pages(raw)


@query("""
SELECT 'chapter' AS step, '' AS rule, url, sum(length(url) % 4 + 1) AS attempts FROM pages
GROUP BY url HAVING sum(length(url) % 4 + 1) < 3""")
def quarantine_retry(spark, sf_dir):
    failed = pages_of(spark, sf_dir).select(
        "url", F.lit("").alias("rule"), (F.length("url") % 4 + 1).alias("attempts"))
    return quarantine.retry(quarantine.as_quarantine(failed, "chapter"))


LEDGER_PASSES = 4


@query("""
SELECT 'chapter' AS step, 'site' AS rule, 'http://a/' || conv_id || '/' || turn AS url,
       CAST(CASE (conv_id * 7 + turn) % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INT) AS attempts,
       CASE (conv_id * 7 + turn) % 5 WHEN 1 THEN 'given up' WHEN 3 THEN 'open' ELSE 'done' END AS state
FROM conversations WHERE (conv_id * 7 + turn) % 5 < 4""")
def retry_ledger(spark, sf_dir):
    """Four passes over pages that are missing in the first two, in all, in the second and in the last of them, or never."""
    case = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(5))
    pages = table(spark, sf_dir, "conversations").select(
        F.lit("chapter").alias("step"), F.lit("site").alias("rule"),
        F.format_string("http://a/%d/%d", "conv_id", "turn").alias("url"), case.alias("case"))
    catalog = Catalog.create(spark, new_path(spark, "catalog"), ["ledger"])
    for batch in range(1, LEDGER_PASSES + 1):
        missing = {1: [0, 1], 2: [0, 1, 2], 3: [1], 4: [1, 3]}[batch]
        failed, found = pages.where(F.col("case").isin(missing)), pages.where(~F.col("case").isin(missing))
        changed = quarantine.merge_ledger(catalog.ledger(before=batch), failed, found)
        catalog.commit(batch, {"ledger": changed})
    return catalog.ledger()


@query("""
SELECT event_id, ts + INTERVAL 8 HOUR AS book_time, ts AS series_time FROM events""")
def clock_columns(spark, sf_dir):
    """The clocks of the jobs at given moments: books keep UTC+8, series the session's own time."""
    return table(spark, sf_dir, "events").select(
        "event_id", clock.book_time(F.col("ts")).alias("book_time"), clock.series_time(F.col("ts")).alias("series_time"))


SCANNED = "page_id bigint, host string, n_chars bigint"


@query(f"SELECT page_id, {HOST_SQL} AS host, length(html) AS n_chars FROM pages")
def stream_pages(spark, sf_dir):
    out = new_path(spark, "polled")

    def work(pages, batch):
        scanned = page_source.with_host(pages).select("page_id", "host", F.length("html").cast("long").alias("n_chars"))
        scanned.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    # A table is a file or a folder of files.  The braces make the path a pattern, which may stand for either.
    stream = page_stream(spark, f"{sf_dir}/{{pages.parquet}}", glob="*")
    spark.createDataFrame([], SCANNED).write.parquet(f"{out}/batch=0")  # there is no batch if there are no pages
    poll(stream, work, new_path(spark, "poll")).awaitTermination()
    return spark.read.schema(SCANNED).parquet(out).drop("batch")


@query("SELECT p_size AS movie_id, p_name AS title, min(p_partkey) % 2 AS first_file FROM part WHERE false GROUP BY ALL"
       " UNION ALL SELECT CAST(p_size AS BIGINT), p_name, min(p_partkey % 2) FROM part GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    """Files that overlap are polled one by one; a known title is not inserted again."""
    folder = new_path(spark, "landing")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("long").alias("movie_id"), F.col("p_name").alias("title"))
    for n in (0, 1):
        parts.where(F.col("p_partkey") % 2 == n).write.mode("append").parquet(folder)
    catalog = Catalog.create(spark, new_path(spark, "catalog"), ["episode"])

    def work(batch_rows, batch):
        first = batch_rows.select("p_partkey", "movie_id", "title", F.lit("qvod").alias("kind"),
                                  (F.col("p_partkey") % 2).cast("string").alias("url"))
        fresh = lookup.new_rows(first, catalog.table("episode", before=batch), ["kind", "movie_id", "title"],
                                ["p_partkey"])
        catalog.commit(batch, {"episode": with_defaults(fresh, "episode")})

    stream = page_stream(spark, folder, files_per_batch=1, schema="p_partkey bigint, movie_id bigint, title string")
    poll(stream, work, new_path(spark, "poll")).awaitTermination()
    return catalog.table("episode").select("movie_id", "title", F.col("url").cast("long").alias("first_file"))
