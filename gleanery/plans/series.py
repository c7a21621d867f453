"""The series job: list pages, info pages, play pages, media source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import clock, fixed_values as fixed, text, titles
from gleanery.functions.text import first_filled
from gleanery.functions.urls import host, resolve, url_key
from gleanery.operators import extract, incremental, lookup, quarantine
from gleanery.operators.skew import first_per_key, relevant, salted_join
from gleanery.plans.memory import Memory
from gleanery.plans.site import PAGE_ID, NextLinks, Site, set_aside, stack, usable_rules
from gleanery.schemas import with_defaults
from gleanery.session import counted, write_out
from gleanery.sources.catalog import Catalog
from gleanery.sources.rules import PATTERNS, SERIES

INFO_FIELDS = ["class", "image", "title", "location", "intro", "publicyear", "actors", "director"]
# Rule fields by kind of link: region, item, play page, and the switch that
# says that one play page leads to the whole series.
KINDS = {
    fixed.BAIDU: ("BaiduAreaRule", "BaiduDramaRule", "DramaPageBaiduRule", "SourceBaiduRule"),
    fixed.QVOD: ("KuaibAreaRule", "KuaibDramaRule", "DramaPageKuaibRule", "SourceKuaibRule"),
}
AREA_RULES = [r for rules_of in KINDS.values() for r in rules_of[:2]]


def area_items(html: Column, kind: str) -> Column:
    """Links in the region of a kind on an info page, in page order.

    With the switch set, the first link that has no media URL of its own is
    the last one.
    """
    area, item, _, whole_series = KINDS[kind]
    items = extract.region_matches(html, F.col(area), F.col(item), ["title", "playurl", "url"])

    def cut(found: Column) -> Column:
        first = F.array_position(F.transform(found, lambda i: i["url"] == ""), True)
        size = F.when((F.col(whole_series) != "") & (first > 0), first.cast("int")).otherwise(F.size(found))
        return F.slice(found, F.lit(1), size)

    return F.when(extract.is_enabled(F.col(area)) & extract.is_enabled(F.col(item)), text.let(items, cut))


def harvest_series(catalog: Catalog, rules: DataFrame, pages: DataFrame, batch: int, *,
                   as_of: Column | None = None, older: bool = False, writer: str = "", memory: Memory | None = None) -> None:
    """Harvest one crawl pass into batch ``batch`` of the catalog; ``pages`` and ``memory`` as in ``harvest_books``.

    ``older`` gives the results of the older version: stored series are found
    by equal title instead of by a title that contains the harvested one,
    texts keep tags and the site's name, episode titles get the basic clean-up,
    and the episodes of a source file stay in its order.
    """
    now = clock.series_time() if as_of is None else as_of.cast("timestamp_ntz")
    aside: list[DataFrame] = []

    rules, bad_rules = usable_rules(rules, SERIES, pages)
    aside.append(set_aside(bad_rules, "rule", F.col("reason"), url="ListPageUrl"))
    rules = rules.select("rule", "_charset", "SiteName", "ListPageUrl",
                         "SourceBaiduRule", "SourceKuaibRule", *PATTERNS[SERIES])
    site = Site.of(pages, rules, memory)
    ledger = write_out(catalog.ledger(before=batch), "ledger")

    # Lists.
    onward = NextLinks(site, {"next": extract.next_link(F.col("html"), F.col("NextListRule"), F.col("url"))},
                       rules.select("rule", host(F.col("ListPageUrl")).alias("host")))

    def listed_on(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        opened = site.open(lists, "html", "url", "ListInfoRule")
        found = extract.list_records(opened.where("found").withColumnRenamed("url", "base"),
                                     [*PAGE_ID, "step", "base"], F.col("html"), F.col("ListInfoRule"))
        links = {c: resolve(F.col(c), F.col("base")) for c in ("url", "image")}
        return found.withColumns(links).drop("base"), opened.where("found is null").select(*PAGE_ID)

    starts = rules.select(F.col("rule").alias("seed"), "rule", url_key(F.col("ListPageUrl")).alias("key"))
    texts = ", ".join(f"{f} string" for f in [*extract.LIST_FIELDS, "info"])
    listed, missing = site.items(onward.walk(starts, "next").select(*PAGE_ID, "step"), f"pos bigint, {texts}", listed_on)
    aside.append(set_aside(missing, "list", "missing_page", url="key"))
    listed = first_per_key(listed.withColumn("key", url_key(F.col("url"))), PAGE_ID, ["step", "pos"])
    if memory is not None:
        listed = listed.withColumn("source", F.concat_ws("\n", *PAGE_ID))
        again = ledger.where("state = 'open'").withColumn("key", url_key(F.col("url")))
        listed = write_out(memory.awake(listed, again), "awake")

    # Info pages.
    opened = site.open(listed, "html", "SiteName", "SourceBaiduRule", "SourceKuaibRule", "InfoRule", *AREA_RULES)
    opened = opened.withColumn("info_page", extract.first_match(F.col("html"), F.col("InfoRule"), INFO_FIELDS))
    opened = opened.withColumns({kind: area_items(F.col("html"), kind) for kind in KINDS})
    opened, n_pages = counted(opened.withColumn("missing", F.col("found").isNull()).drop(
        "found", "html", "InfoRule", "SourceBaiduRule", "SourceKuaibRule", *AREA_RULES), "info")

    # Stored series by title.
    stored, classes = (catalog.table(t, before=batch).drop("batch") for t in ("series", "class"))
    reason = F.when(F.col("missing"), "missing_page").when(text.trim_dots(F.col("title")) == "", "empty_title")
    opened, bad = quarantine.split(opened, reason)
    aside.append(set_aside(bad, "info", F.col("reason")))
    if older:
        hits = relevant(stored, opened, ["title"]).groupBy("title").agg(F.min("id").alias("known_id"))
    else:
        hits = lookup.contains_match(opened, stored).select("title", F.col("id").alias("known_id"))
    matched = write_out(salted_join(opened, hits, ["title"], "left", PAGE_ID, rows=n_pages), "matched")

    def chain(field: str, *rest: str) -> Column:
        return first_filled(F.col(field), F.col(f"info_page.{field}"), *rest)

    def without_site(words: Column) -> Column:
        return words if older else text.strip_site_name(words, F.col("SiteName"))

    image = first_filled(F.col("image"), resolve(F.col("info_page.image"), F.col("url")))
    candidates = matched.where("known_id is null").withColumn(
        "reason", F.when(~F.col("info_page.matched"), "no_match:InfoRule")
        .when(F.col("info_page.title") == "", "empty_title"))
    candidates, bad = candidates.where("reason is null").drop("reason"), candidates.where("reason is not null")
    aside.append(set_aside(bad, "info", F.col("reason")))
    candidates = candidates.select(
        *PAGE_ID, "url", "step", "pos", F.col("info_page.title").alias("title"),
        chain("class", fixed.DEFAULT_CLASS).alias("class_name"), chain("location").alias("location"),
        chain("publicyear", fixed.DEFAULT_YEAR).alias("public_year"),
        (chain("actors") if older else text.strip_tags(chain("actors"))).alias("actors"),
        chain("director").alias("director"),
        without_site(first_filled(F.col("info"), F.col("info_page.intro"))).alias("info"),
        without_site(chain("intro")).alias("intro"),
        image.alias("image_url"), titles.standard_title(F.col("info_page.title")).alias("standard_title"))
    candidates, bad = quarantine.fitting(candidates, "series")
    aside.append(set_aside(bad, "info", F.col("reason")))
    fresh = write_out(lookup.new_rows(candidates, stored, ["title"], ["rule", "step", "pos"]), "new-series")
    new_classes = write_out(incremental.new_classes(fresh, classes, fixed.SERIES_MODEL_ID), "new-classes")
    of_model = classes.where(F.col("model_id") == fixed.SERIES_MODEL_ID)
    fresh = incremental.attach_class(fresh, of_model.unionByName(new_classes), PAGE_ID)
    fresh = write_out(incremental.assign_ids(fresh, ["title"], stored), "series")
    face = F.when(F.col("image_url") != "", F.format_string(fixed.COVER_PATH, "id")).otherwise("")
    new_series = with_defaults(fresh.withColumn("face_image", face), "series",
                               {"insert_time": now, "update_time": now})
    covers = incremental.cover_worklist(fresh).unionByName(incremental.refetch_covers(
        matched.where("known_id is not null").select(F.col("known_id").alias("id"), image.alias("image_url")), stored))

    # The series of every info page: matched by the list title, else by its own.
    by_title = relevant(stored, candidates, ["title"]).select("title", "id").unionByName(fresh.select("title", "id"))
    by_title = by_title.groupBy("title").agg(F.min("id").alias("movie_id"))
    own = salted_join(candidates.select(*PAGE_ID, "title"), by_title, ["title"], "inner", PAGE_ID, rows=n_pages)
    owners = matched.where("known_id is not null").select(*PAGE_ID, F.col("known_id").alias("movie_id")).unionByName(
        own.select(*PAGE_ID, "movie_id"))
    owners = write_out(owners, "owners")
    names = stored.select(F.col("id").alias("movie_id"), F.col("title").alias("movie_title"))
    names = relevant(names, owners, ["movie_id"]).unionByName(
        fresh.select(F.col("id").alias("movie_id"), F.col("title").alias("movie_title")))
    owners = salted_join(owners, names, ["movie_id"], "inner", PAGE_ID, rows=n_pages)
    areas = salted_join(matched.select(*PAGE_ID, "url", *KINDS), owners, PAGE_ID, "inner", PAGE_ID, rows=n_pages)
    owner_columns = ["rule", "movie_id", "movie_title"]

    def items_of(kind: str) -> DataFrame:
        items = areas.select(*owner_columns, F.lit(kind).alias("kind"), F.col("url").alias("base"),
                             F.posexplode(kind).alias("item", "_i"))
        title = F.col("_i.title") if kind == fixed.BAIDU else first_filled(F.col("_i.title"), fixed.DEFAULT_EPISODE)
        return items.select(*owner_columns, "kind", F.col("item").cast("long"), title.alias("title"),
                            F.col("_i.url").alias("url"), resolve(F.col("_i.playurl"), F.col("base")).alias("link"))

    items = write_out(stack([items_of(k) for k in KINDS]), "items")
    inline = items.where("url <> ''").select(*owner_columns, "kind", "item", "title", "url",
                                             F.lit(0).cast("long").alias("pos"), F.lit("inline").alias("leg"))

    # Play pages: a media URL, or the link to a source file.
    asked = items.where("url = ''").drop("url").withColumn("key", url_key(F.col("link")))

    def played(kind: str) -> DataFrame:
        _, item, play, _ = KINDS[kind]
        opened = site.open(asked.where(F.col("kind") == kind), "html", "url", item, play)
        aside.append(set_aside(opened.where("found is null"), "play", "missing_page", url="link"))
        return extract.play_page_links(opened.where("found"), [*owner_columns, "kind", "item", "title"],
                                       F.col("html"), F.col("url"), F.col(item), F.col(play))

    play = write_out(stack([played(k) for k in KINDS]), "play")
    direct = play.where("leg = 'direct'").withColumn("title", first_filled(F.col("title"), F.col("page_title")))
    direct = direct.withColumn("pos", F.lit(0).cast("long")).select(*inline.columns)

    # Source files.
    sources = play.where("leg = 'source'").withColumn("key", url_key(F.col("url")))
    sources = sources.groupBy(*owner_columns, "key").agg(F.min(F.struct("kind", "item")).alias("_first"))
    opened = site.open(sources.select(*owner_columns, "key", "_first.*"), "html")
    aside.append(set_aside(opened.where("found is null"), "source", "missing_page", url="key"))
    links = extract.media_links(
        opened.where("found").withColumnRenamed("kind", "found_in"),
        [*owner_columns, "found_in", "item", "key"], text.media_decode(F.col("html")))
    links = write_out(links, "links")
    aside.append(set_aside(links.where("file_name is null"), "source", "no_file_name"))
    clean = titles.episode_title_basic if older else titles.episode_title
    from_source = links.where("file_name is not null").withColumn(
        "title", clean(F.col("file_name"), F.col("movie_title")))
    from_source = from_source.withColumn("leg", F.lit("source")).select(*inline.columns, "found_in")

    # Episodes.
    every = stack([inline.withColumn("found_in", F.col("kind")), direct.withColumn("found_in", F.col("kind")),
                   from_source])
    episodes, bad = quarantine.fitting(write_out(every, "candidates"), "episode")
    aside.append(set_aside(bad, "episode", F.col("reason")))
    known = catalog.table("episode", before=batch)
    order = ["found_in", "item", "pos", "title"] if older else ["found_in", "item", "title", "pos"]
    episodes = lookup.new_rows(episodes, known, ["kind", "movie_id", "title"], order)
    episodes = write_out(incremental.assign_ids(episodes, ["movie_id", *order, "kind"], known), "episodes")
    pointers = incremental.last_children(episodes.where("leg <> 'direct'"), "movie_id", ["id"], {
        "last_id": F.col("id"), "last_title": F.col("title"), "update_time": now})
    if memory is not None:
        of_series = owners.select(F.concat_ws("\n", *PAGE_ID).alias("source"), "rule", "movie_id")
        linked = asked.select("rule", "movie_id", "key").unionByName(sources.select("rule", "movie_id", "key")).distinct()
        linked = salted_join(linked, of_series, ["rule", "movie_id"], "inner", ["key"])
        memory.keep("touched", stack([t.select("source", *PAGE_ID) for t in (listed, linked)]).distinct())

    set_asides = write_out(stack(aside), "aside")
    catalog.commit(batch, {
        "class": new_classes,
        "series": new_series,
        "episode": with_defaults(episodes, "episode", {"update_time": now}),
        "pointer": pointers.withColumnRenamed("movie_id", "parent_id").withColumn("parent", F.lit("series")),
        "cover": covers.withColumn("parent", F.lit("series")),
        "quarantine": set_asides,
        "ledger": site.settle(ledger, set_asides),
    }, writer)
