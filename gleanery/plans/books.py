"""The book job: list pages, info pages, chapter lists, chapters.

Each level is one wide step over all sites.  Intermediate tables are narrow
and written out; page text is read again where it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import clock, fixed_values as fixed, text
from gleanery.functions.urls import host, resolve, site_root, url_key
from gleanery.operators import chains, extract, incremental, lookup, quarantine
from gleanery.operators.skew import first_per_key, lookup_join, salted_join
from gleanery.schemas import MAX_LENGTHS, with_defaults
from gleanery.plans.memory import Memory
from gleanery.plans.site import PAGE_ID, NextLinks, Site, set_aside, stack, usable_rules
from gleanery.session import counted, write_out
from gleanery.sources.catalog import Catalog
from gleanery.sources.rules import BOOK, PATTERNS

LIST_FIELDS = ["title", "url"]
INFO_FIELDS = ["title", "author", "intro", "length", "status", "cls", "image"]
CHAPTER_FIELDS = ["title", "user", "content"]


def asked_again(items: DataFrame, resumed: DataFrame, ledger: DataFrame, rows: int) -> DataFrame:
    """``resumed``, and of books of which nothing is, the listed chapters from the first on that was missing before.

    The last chapter of a book may not be on its list, if a next link led to it; after it nothing is resumed.
    """
    missed, n = counted(ledger.where("step = 'chapter' AND state <> 'done'").select("rule", F.col("url").alias("key")), "missed")
    if not n:
        return resumed
    begins = lookup_join(items, missed, PAGE_ID, "inner", ["source", "pos"]).groupBy("source").agg(F.min("pos").alias("_from"))
    begins = begins.join(resumed.select("source").distinct(), "source", "left_anti")
    again = salted_join(items, begins, ["source"], "inner", ["pos"], rows=rows).where("pos >= _from").select(*resumed.columns)
    return resumed.unionByName(again)


def harvest_books(catalog: Catalog, rules: DataFrame, pages: DataFrame, batch: int, *,
                  blacklist: DataFrame | None = None, replace_list: list[tuple[str, str]] = (),
                  as_of: Column | None = None, writer: str = "", memory: Memory | None = None) -> None:
    """Harvest one crawl pass into batch ``batch`` of the catalog.

    ``pages`` hold page_id, url and html, or, as bytes, content: these are decoded by the charset of the rule that reads them.
    With a ``memory`` of earlier passes, ``pages`` are those that are new, and only books are looked at that they bear on.
    """
    now = clock.book_time() if as_of is None else as_of.cast("timestamp_ntz")
    aside: list[DataFrame] = []

    rules, bad_rules = usable_rules(rules, BOOK, pages)
    aside.append(set_aside(bad_rules, "rule", F.col("reason"), url="ListUrl"))
    rules = rules.select("rule", "_charset", site_root(F.col("SiteDomain")).alias("root"), "TargetSiteUrl", "ListUrl",
                         *PATTERNS[BOOK])
    site = Site.of(pages, rules, memory)
    ledger = write_out(catalog.ledger(before=batch), "ledger")

    def link(rule_field: str) -> Column:
        return extract.next_link(F.col("html"), F.col(rule_field), F.col("root"), whole=True)

    home = [rules.select("rule", host(F.col(c)).alias("host")) for c in ("ListUrl", "root")]
    onward = NextLinks(site, {"next_list": link("ListUrlNextRule"), "next_content": link("NextContentRule"),
                              "next_chapter": link("NextChapterUrlRule")}, stack(home))

    # Lists and the books on them.
    def listed_on(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        opened = site.open(lists, "html", "root", "ListRule")
        found = extract.explode_matches(opened.where("found"), [*PAGE_ID, "step", "root"],
                                        extract.all_matches(F.col("html"), F.col("ListRule"), LIST_FIELDS))
        return found.withColumn("url", resolve(F.col("url"), F.col("root"))).drop("root"), opened.where("found is null").select(*PAGE_ID)

    starts = rules.select(F.col("rule").alias("seed"), "rule", url_key(F.col("ListUrl")).alias("key"))
    listed, missing = site.items(onward.walk(starts, "next_list").select(*PAGE_ID, "step"),
                                 "pos bigint, title string, url string", listed_on)
    aside.append(set_aside(missing, "list", "missing_page", url="key"))
    if blacklist is not None:
        listed = lookup.exclude(listed, blacklist, "title", ["rule", "step", "pos"])
    listed = listed.withColumn("key", url_key(F.col("url")))
    listed = first_per_key(listed, PAGE_ID, ["step", "pos"]).withColumn("source", F.concat_ws("\n", *PAGE_ID))
    if memory is not None:
        listed = memory.awake(listed, ledger.where("state = 'open'").withColumn("key", url_key(F.col("url"))))
    listed = write_out(listed, "listed")  # read more than once

    # Info pages.
    info = extract.first_match(F.col("html"), F.col("InfoRule"), INFO_FIELDS)
    opened = site.open(listed.withColumnRenamed("title", "list_title").withColumnRenamed("url", "link"),
                       "html", "root", "TargetSiteUrl", "InfoRule", "ChapterListUrlRule")
    opened = opened.withColumn("_info", info).withColumn("list_link", link("ChapterListUrlRule"))
    found = opened.select(
        "source", *PAGE_ID, F.col("link").alias("url"), "step", "pos", "list_link", "root", "TargetSiteUrl", "_info.*",
        F.col("found").isNull().alias("missing")).drop("whole").withColumnRenamed("cls", "class_name")
    reason = (F.when(F.col("missing"), "missing_page").when(~F.col("matched"), "no_match:InfoRule")
              .when(F.col("title") == "", "empty_title").when(F.col("endless"), "endless_rule:intro"))
    found, n_found = counted(text.content_filter(found, "intro", replace_list, "endless"), "info")
    found, bad = quarantine.split(found, reason)
    found = found.drop("endless")
    aside.append(set_aside(bad, "info", F.col("reason")))
    found, bad = quarantine.fitting(found, "book")
    aside.append(set_aside(bad, "info", F.col("reason")))

    # Books and classes.
    stored, classes = catalog.books(batch, of=found), catalog.table("class", before=batch).drop("batch")
    fresh = found.withColumns({"length": text.to_int(F.col("length")), "status": text.status_code(F.col("status"))})
    fresh = write_out(lookup.new_rows(fresh, stored, ["title", "author"], ["rule", "step", "pos"]), "new-books")
    new_classes = write_out(incremental.new_classes(fresh, classes, fixed.BOOK_MODEL_ID), "new-classes")
    fresh = incremental.attach_class(fresh, classes.unionByName(new_classes), PAGE_ID)
    fresh = incremental.assign_ids(fresh, ["title", "author"], catalog.table("book", before=batch))
    new_books = write_out(with_defaults(fresh, "book", {"add_time": now, "update_time": now}), "books")
    books = stored.select(*new_books.columns).unionByName(new_books)
    owners = first_per_key(books.select("title", "author", F.col("id").alias("book_id"), "class_id", "class_name",
                                        "last_chapter_id", "last_chapter_title"), ["title", "author"], ["book_id"])
    found = found.drop("class_name")
    owned = write_out(salted_join(found, owners, ["title", "author"], "inner", PAGE_ID, rows=n_found)
                      .withColumnRenamed("title", "book_title"), "owned")
    covers = owned.where("image <> ''").select(
        F.lit("book").alias("parent"), F.col("book_id").alias("id"),
        resolve(F.col("image"), F.col("root")).alias("image_url"),
        F.concat("TargetSiteUrl", F.lit(fixed.BOOK_COVER_PATH), "book_id").alias("path"))

    # Chapter lists: on a page of their own or on the info page.
    target = owned.select("source", "rule", F.coalesce(url_key(F.col("list_link")), F.col("key")).alias("key"))
    opened = site.open(target, "html", "root", "ChapterListRule")
    aside.append(set_aside(opened.where("found is null"), "chapter_list", "missing_page", url="key"))
    items = extract.explode_matches(
        opened.where("found"), ["source", "rule", "root"],
        extract.all_matches(F.col("html"), F.col("ChapterListRule"), LIST_FIELDS))
    items, n_items = counted(items, "chapter-items")
    parents = owned.select("source", F.col("last_chapter_id").alias("last_id"),
                           F.col("last_chapter_title").alias("last_title"))
    known = lookup_join(catalog.table("chapter", before=batch).select("book_id", "title"),
                        owned.select("book_id", "source"), ["book_id"], "inner", ["title"])
    items = items.withColumn("key", url_key(resolve(F.col("url"), F.col("root"))))
    resumed = incremental.resume_after_last(items, parents, "source", n_items)
    if memory is not None:
        resumed = asked_again(items, resumed, ledger, n_items)
    items = incremental.take_until_known(resumed, known, "source", n_items)
    items = write_out(items.select("source", "rule", "pos", "key"), "wanted-chapters")

    # Chapter pages, the pages that continue a chapter, the chapters that follow.  A page that several listed chapters lead
    # to counts from the first of them.
    chapters = onward.first(items.select(F.col("source").alias("group"), *PAGE_ID, F.col("pos").alias("rank")), "next_chapter")
    chapters = chapters.withColumnsRenamed({"group": "source", "rank": "pos"})
    n_chapters = chapters.count()
    starts = chapters.select(F.struct(*PAGE_ID).alias("seed"), *PAGE_ID).distinct()
    parts = onward.walk(starts, "next_content").withColumnRenamed("step", "part")
    content = extract.first_match(F.col("html"), F.col("ContentRule"), CHAPTER_FIELDS)
    parts = site.open(parts, "html", "ContentRule").withColumn("_content", content)
    parts = write_out(parts.select(
        "seed", *PAGE_ID, F.col("part").alias("step"), "_content.title", F.col("_content.content").alias("text"),
        F.when(F.col("found").isNull(), "missing_page").when(~F.col("_content.matched"), "no_match:ContentRule")
        .alias("reason")), "parts")
    heads = parts.groupBy("seed").agg(
        F.max(F.when(F.col("step") == 0, F.col("title"))).alias("title"),
        F.max(F.when(F.col("step") == 0, F.length("text"))).alias("text_length"), F.max("reason").alias("reason"))
    heads = heads.select("seed.*", "title", "text_length", "reason")
    judged = salted_join(chapters, heads, PAGE_ID, "inner", ["source", "pos", "step"], rows=n_chapters)
    judged = write_out(judged.withColumn("reason", F.coalesce("reason", F.when(
        F.length("title") > MAX_LENGTHS["chapter"]["title"], "too_long:title"))), "judged")
    failed = judged.where("reason is not null")
    aside.append(set_aside(failed, "chapter", F.col("reason"), url="key"))
    # The first chapter that fails ends the pass for its book.
    ends = failed.groupBy("source").agg(
        F.min(F.struct("pos", "step")).alias("_end"))
    kept = salted_join(judged.where("reason is null"), ends, ["source"], "left", ["pos", "step"],
                       rows=n_chapters)
    kept = kept.where(F.col("_end").isNull() | (F.struct("pos", "step") < F.col("_end"))).drop("_end", "reason")
    kept = salted_join(kept, owned.select("source", "book_id", "book_title", "class_id", "class_name"), ["source"],
                       "inner", ["pos", "step"], rows=n_chapters)
    # A page that is reached twice is saved once; equal titles of different pages are different chapters.
    kept = write_out(first_per_key(kept, ["book_id", *PAGE_ID], ["source", "pos", "step"]), "kept")
    saved = write_out(incremental.assign_ids(kept, ["book_id", "source", "pos", "step"],
                                             catalog.table("chapter", before=batch)), "chapters")

    texts = chains.stitch(parts.where("reason is null").select("seed", "step", "text"), ["seed"])
    texts = texts.select("seed.*", "content")
    numbered = saved.select(*PAGE_ID, F.col("id").alias("chapter_id"), "title")
    texts = salted_join(numbered, texts, PAGE_ID, "inner", ["chapter_id"], rows=n_chapters)
    texts = text.content_filter(texts, "content", replace_list, "endless")
    if replace_list:
        aside.append(set_aside(texts.where("endless"), "chapter_content", "endless_rule", url="key"))
    texts = texts.where("NOT endless").withColumn("content", text.html_decode(F.col("content")))
    pointers = incremental.last_children(saved, "book_id", ["id"], {
        "last_id": F.col("id"), "last_title": F.col("title"), "update_time": now})
    if memory is not None:
        of_parts = parts.where("step > 0").select(F.col("seed.rule").alias("rule"), F.col("seed.key").alias("_first"), "key")
        of_parts = salted_join(of_parts, chapters.select("source", "rule", F.col("key").alias("_first")), ["rule", "_first"], "inner", ["key"])
        memory.keep("touched", stack([t.select("source", *PAGE_ID) for t in (listed, target, chapters, of_parts)]).distinct())

    set_asides = write_out(stack(aside), "aside")
    catalog.commit(batch, {
        "class": new_classes,
        "book": new_books,
        "chapter": with_defaults(saved, "chapter", {"update_time": now}),
        "chapter_content": texts,
        "pointer": pointers.withColumnRenamed("book_id", "parent_id").withColumn("parent", F.lit("book")),
        "cover": covers,
        "quarantine": set_asides,
        "ledger": site.settle(ledger, set_asides),
    }, writer)
