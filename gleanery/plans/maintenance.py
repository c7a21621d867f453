"""Queries: incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import fixed_values as fixed
from gleanery.operators import incremental
from gleanery.plans.registry import query, table


def items_of(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"),
                                                        F.col("text").alias("title"))


@query("""
WITH i AS (SELECT conv_id, turn AS pos, CASE WHEN (conv_id + turn) % 11 = 7 THEN '' ELSE text END AS title
           FROM conversations),
l AS (SELECT conv_id, max(CASE WHEN turn = conv_id % 4 AND conv_id % 9 <> 0 THEN text ELSE '' END) AS last,
             conv_id % 13 AS last_id FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, last_id, min(CASE WHEN title = last THEN pos END) AS cut,
             min(CASE WHEN title = '' THEN pos END) AS gap
      FROM i JOIN l USING (conv_id) GROUP BY ALL)
SELECT conv_id, pos, title FROM i JOIN b USING (conv_id)
WHERE last_id = 0 OR (cut < coalesce(gap, cut + 1) AND pos > cut)""")
def resume_after_last(spark, sf_dir):
    items = items_of(spark, sf_dir)
    last = F.when((F.col("pos") == F.col("conv_id") % 4) & (F.col("conv_id") % 9 != 0), F.col("title"))
    parents = items.groupBy("conv_id").agg(F.max(last).alias("last_title")).withColumn(
        "last_id", F.when(F.col("conv_id") % 13 != 0, F.col("conv_id") % 13))
    empty = F.when((F.col("conv_id") + F.col("pos")) % 11 == 7, "").otherwise(F.col("title"))
    return incremental.resume_after_last(items.withColumn("title", empty), parents, "conv_id")


@query("""
WITH i AS (SELECT conv_id, turn AS pos, CASE WHEN (conv_id + turn) % 11 = 7 THEN '' ELSE text END AS title
           FROM conversations),
s AS (SELECT conv_id, min(pos) AS stop FROM i WHERE title = '' OR EXISTS (
        SELECT 1 FROM conversations k WHERE k.conv_id = i.conv_id AND k.text = i.title AND length(k.text) > 400)
      GROUP BY conv_id)
SELECT conv_id, pos, title FROM i LEFT JOIN s USING (conv_id) WHERE stop IS NULL OR pos < stop""")
def take_until_known(spark, sf_dir):
    items = items_of(spark, sf_dir)
    known = items.where("length(title) > 400")
    empty = F.when((F.col("conv_id") + F.col("pos")) % 11 == 7, "").otherwise(F.col("title"))
    return incremental.take_until_known(items.withColumn("title", empty), known, "conv_id")


@query("""
WITH f AS (SELECT DISTINCT lang AS class_name FROM documents WHERE lang <> 'en')
SELECT 1 AS id, '其他' AS class_name, CAST(0 AS BIGINT) AS parent_id, CAST(4 AS INT) AS model_id
UNION ALL SELECT 2, 'en', 1, 4
UNION ALL SELECT 2 + row_number() OVER (ORDER BY class_name), class_name, 1, 4 FROM f""")
def class_get_or_create(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("class_name"))
    stored = spark.createDataFrame([(1, fixed.DEFAULT_CLASS, 0, 4), (2, "en", 1, 4)],
                                   "id bigint, class_name string, parent_id bigint, model_id int")
    return stored.unionByName(incremental.new_classes(names, stored, fixed.BOOK_MODEL_ID))


@query("""
WITH d AS (SELECT source AS title, lang AS author, min(doc_id) AS first_id, arg_min(n_chars, doc_id) AS length,
                  source < 'src2' AS known FROM documents GROUP BY ALL)
SELECT title, author, first_id + 1 AS id, CAST(length AS INT) AS length, false AS created FROM d WHERE known
UNION ALL
SELECT title, author, row_number() OVER (ORDER BY title, author) + (SELECT max(first_id) + 1 FROM d WHERE known),
       CAST(length AS INT), true FROM d WHERE NOT known""")
def book_get_or_create(spark, sf_dir):
    harvested = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("author"), F.col("n_chars").alias("length"))
    stored = harvested.where("title < 'src2'").groupBy("title", "author").agg(
        (F.min("doc_id") + 1).alias("id"), F.min_by("length", "doc_id").cast("int").alias("length"))
    fresh = incremental.get_or_create(harvested, stored, ["title", "author"], "book", order=["doc_id"])
    kept = stored.select("title", "author", "id", "length", F.lit(False).alias("created"))
    return kept.unionByName(fresh.select("title", "author", "id", "length", F.lit(True).alias("created")))


@query("""
WITH d AS (SELECT source || '-' || lang AS title, min(doc_id) AS first_id, source, lang FROM documents GROUP BY ALL),
s AS (SELECT title, first_id + 1 AS id, lang FROM d WHERE source < 'src2')
SELECT 'insert' AS action, title, row_number() OVER (ORDER BY title) + (SELECT max(id) FROM s) AS id, '' AS path
FROM d WHERE source >= 'src2'
UNION ALL SELECT 'cover', '', id, '/u/MovieFace/' || id || '.jpg' FROM s WHERE lang = 'en'""")
def series_upsert(spark, sf_dir):
    harvested = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit("-"), "lang").alias("title"), "source", "lang")
    stored = harvested.where("source < 'src2'").groupBy("title", "lang").agg((F.min("doc_id") + 1).alias("id"))
    stored = stored.withColumn("face_image", F.when(F.col("lang") == "en", "").otherwise("x"))
    fresh = incremental.get_or_create(harvested, stored, ["title"], "series", order=["doc_id"])
    matched = harvested.join(stored.select("title", "id"), "title").select("id", F.lit("http://i/1").alias("image_url"))
    covers = incremental.refetch_covers(matched, stored)
    return fresh.select(F.lit("insert").alias("action"), "title", "id", F.lit("").alias("path")).unionByName(
        covers.select(F.lit("cover").alias("action"), F.lit("").alias("title"), "id", "path"))


@query("""
SELECT user_id AS parent_id, arg_max(event_id, (ts, event_id)) AS last_id,
       arg_max(event_type, (ts, event_id)) AS last_title FROM events GROUP BY user_id""")
def update_last_pointer(spark, sf_dir):
    children = table(spark, sf_dir, "events").withColumnRenamed("user_id", "parent_id")
    return incremental.last_children(children, "parent_id", ["ts", "event_id"],
                                     {"last_id": F.col("event_id"), "last_title": F.col("event_type")})


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
WHERE r = 1""")
def first_item_per_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return incremental.first_items(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
