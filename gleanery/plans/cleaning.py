"""Queries: text and title clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import fixed_values as fixed, text, titles
from gleanery.operators import extract
from gleanery.plans.registry import query, sql_replace, sql_text, table
from gleanery.session import spread
from gleanery.sources import wordlists

WORD_SQL = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
SITE_SQL = rf"[\\{WORD_SQL}./。]{{3,20}}\.[com|net|org|cn|co|info|us|cc|xxx|tv|ws|hk|tw]+"
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
# Rounds of the oracle, which cannot test for stability.
ROUNDS = 4


def sql_symbols(v: str) -> str:
    v = sql_replace(v, f"[{fixed.DECORATIVE_SYMBOLS}]")
    return sql_replace(v, r"[~@#$%^*()_=\-\+\[\]]")


def sql_blocks(v: str) -> str:
    for name in fixed.BLOCK_ELEMENTS:
        v = sql_replace(v, rf"<{name} [\s\S]*?</{name}>", times=ROUNDS)
    return v


def sql_tags(v: str) -> str:
    for name in fixed.BARE_TAGS:
        v = sql_replace(v, f"</?{name}>", times=ROUNDS)
    return v


def sql_urls(v: str) -> str:
    for p in [*fixed.URL_PREFIXES, SITE_SQL]:
        v = sql_replace(v, p, times=ROUNDS)
    return v


def sql_filter(v: str) -> str:
    v = f"lower(translate({sql_symbols(v)}, {sql_text(WIDE)}, {sql_text(NARROW)}))"
    return sql_urls(sql_replace(sql_tags(sql_blocks(v)), fixed.SYNOPSIS_LEAD, times=ROUNDS))


def _pages(spark, sf_dir, value=F.col):
    return spread(table(spark, sf_dir, "pages")).select("page_id", value("html").alias("text"))


@query(f"SELECT page_id, {sql_symbols('html')} AS text FROM pages")
def filter_symbols(spark, sf_dir):
    return _pages(spark, sf_dir, lambda h: text.drop_symbols(F.col(h)))


BLOCK = "<script a>x</script><a \n<a b>y</a>z</a>"


@query(f"SELECT page_id, {sql_blocks(sql_text(BLOCK) + ' || html')} AS text FROM pages")
def filter_blocks(spark, sf_dir):
    return text.apply_steps(_pages(spark, sf_dir, lambda h: F.concat(F.lit(BLOCK), h)), "text", text.DROP_BLOCKS)


@query(f"SELECT page_id, {sql_tags('html')} AS text FROM pages")
def filter_tags(spark, sf_dir):
    return text.apply_steps(_pages(spark, sf_dir), "text", text.DROP_BARE_TAGS)


@query(f"SELECT page_id, {sql_urls('url || html')} AS text FROM pages")
def filter_urls(spark, sf_dir):
    return text.apply_steps(_pages(spark, sf_dir, lambda h: F.concat("url", h)), "text", text.DROP_URLS)


NESTED = "<<p>p><<<<<<<p>p>p>p>p>p>p><<p>div>"


@query("SELECT page_id, " + sql_replace(f"{sql_text(NESTED)} || html", "</?p>", times=8) + " AS text FROM pages")
def filter_fixpoint(spark, sf_dir):
    nested = _pages(spark, sf_dir, lambda h: F.concat(F.lit(NESTED), h))
    return text.apply_steps(nested, "text", [text.delete_strings(["<p>", "</p>"])])


@query(f"SELECT page_id, {sql_filter('html')} AS text FROM pages")
def content_filter(spark, sf_dir):
    return text.content_filter(_pages(spark, sf_dir), "text")


@query(f"""
SELECT doc_id, translate('ＡＢＣ１２３！　' || text, {sql_text(WIDE)}, {sql_text(NARROW)}) AS text
FROM documents""")
def to_halfwidth(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.to_halfwidth(F.concat(F.lit("ＡＢＣ１２３！　"), "text")).alias("text"))


REPLACE_FILE = "the|DE\r\n\r\n|x\r\nq[a-z]\r\nund|&|ignored\r\naa|a"
MANY_ROUNDS = "a" * 3000  # twelve rounds of the last rule


def sql_replace_rule(name: str, source: str, pattern: str, to: str) -> str:
    """CTEs that loop over one rule until it no longer matches; the test is case-sensitive, the replacement is not."""
    return f"""{name}_r AS (SELECT doc_id, text, 0 AS n FROM {source} UNION ALL
      SELECT doc_id, regexp_replace(text, '(?i){pattern}', '{to}', 'g'), n + 1 FROM {name}_r WHERE regexp_matches(text, '{pattern}')),
    {name} AS (SELECT doc_id, arg_max(text, n) AS text FROM {name}_r GROUP BY doc_id)"""


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text || '{MANY_ROUNDS}' AS text FROM documents),
{sql_replace_rule('r1', 'd', 'the', 'DE')}, {sql_replace_rule('r2', 'r1', 'q[a-z]', '')},
{sql_replace_rule('r3', 'r2', 'und', '&')}, {sql_replace_rule('r4', 'r3', 'aa', 'a')}
SELECT doc_id, text FROM r4""")
def replace_list(spark, sf_dir):
    lines = wordlists.split_lines(spark.createDataFrame([(REPLACE_FILE,)], "value string"), "value")
    rules = wordlists.load_replace_list(wordlists.replace_rules(lines))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(MANY_ROUNDS)).alias("text")))
    return text.apply_replace_list(docs, "text", rules)


ENTITIES = {"copy": "©", "middot": "·", "lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "amp": "&"}
ENTITY_TAIL = "&lt;b&gt; &quot;x&quot;&nbsp;&amp;lt; &unknown; & &#39;&#x4E2D;"


def sql_entities(v: str) -> str:
    v = f"replace(replace({v}, '&#39;', ''''), '&#x4E2D;', '中')"
    for name, char in ENTITIES.items():
        v = f"replace({v}, '&{name};', {sql_text(char)})"
    return v


@query("SELECT page_id, " + sql_entities(
    rf"regexp_extract(html, '<footer>([\s\S]*?)</footer>', 1) || {sql_text(ENTITY_TAIL)}")
    + " AS text FROM pages")
def html_decode(spark, sf_dir):
    footer = extract.first_match(F.col("html"), r"<footer>(?<text>[\s\S]*?)</footer>", ["text"])["text"]
    return _pages(spark, sf_dir, lambda _: text.html_decode(F.concat(footer, F.lit(ENTITY_TAIL))))


@query("""
SELECT p_partkey, 'bdhd://' || p_partkey || '|' || p_name || '|第' || p_partkey || '集.rmvb' AS text FROM part""")
def media_decode(spark, sf_dir):
    encoded = F.concat(
        F.lit("bdhd%3A%2F%2F"), F.col("p_partkey"), F.lit("%7C"), F.replace("p_name", F.lit(" "), F.lit("+")),
        F.lit("%7C\\u7b2c"), F.col("p_partkey"), F.lit("\\u96C6.rmvb"))
    return table(spark, sf_dir, "part").select("p_partkey", text.media_decode(encoded).alias("text"))


CHAPTER_SQL = """
CASE p_partkey % 10
  WHEN 0 THEN '第' || p_partkey || '章-第' || (p_partkey + 3) || '章 ' || p_name
  WHEN 1 THEN '【第' || p_partkey || '章】 ' || p_name
  WHEN 2 THEN 'x第' || p_partkey || '章 ' || p_name || '【求月票】'
  WHEN 3 THEN p_name || '第一百零三章'
  WHEN 4 THEN p_partkey || '-' || (p_partkey + 2) || '章' || p_name
  WHEN 5 THEN '第' || p_partkey
  WHEN 6 THEN p_partkey || '. ' || p_name
  WHEN 7 THEN p_name || '后记 ' || p_brand
  WHEN 8 THEN '第' || p_partkey || '章 ' || p_name || '(上)【紧急!】(求票)'
  ELSE p_name || '大结局' END"""
_shapes = [f"nullif(regexp_extract(t, {sql_text(p)}, 0), '')" for p in fixed.CHAPTER_SHAPES]
_trimmed = "coalesce(found, t)"
for _p in fixed.CHAPTER_TRIMS:
    _trimmed = sql_replace(_trimmed, _p)


@query(f"""
WITH t AS (SELECT p_partkey, {CHAPTER_SQL} AS t FROM part),
f AS (SELECT p_partkey, t, coalesce({', '.join(_shapes)}) AS found FROM t)
SELECT p_partkey, {_trimmed} AS title, found IS NOT NULL AS recognised FROM f""")
def chapter_title(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select("p_partkey", F.expr(CHAPTER_SQL).alias("t"))
    return raw.select("p_partkey", titles.chapter_title(F.col("t")).alias("c")).select("p_partkey", "c.*")
