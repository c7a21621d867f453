from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import sites
from gleanery.plans import QUERIES
from gleanery.plans.books import harvest_books
from gleanery.plans.series import harvest_series
from gleanery.plans.site import Site
from gleanery.schemas import PAGE
from gleanery.sources.catalog import Catalog
from gleanery.streaming.harvest import poll_books, poll_series
from gleanery.streaming.poll import page_stream, poll


def titles(catalog):
    return sorted(tuple(r) for r in catalog.table("chapter").select("batch", "book_title", "title").collect())


def test_polled_passes_equal_batches(spark, tmp_path):
    rules, landing = sites.book_rules(spark), str(tmp_path / "landing")
    streamed = Catalog.create(spark, str(tmp_path / "streamed"))
    batched = Catalog.create(spark, str(tmp_path / "batched"))
    # The page ids of the second pass are higher: a later copy of a page counts.
    passes = [sites.book_pages(spark), sites.book_pages(spark, extra_chapters=(4,)).withColumn("page_id", F.col("page_id") + 100)]
    for n, pages in enumerate(passes, start=1):
        pages.coalesce(1).write.mode("append").parquet(landing)
        poll_books(streamed, rules, landing, str(tmp_path / "checkpoint")).awaitTermination()
        harvest_books(batched, rules, pages, n)
    assert titles(streamed) == titles(batched)
    assert {t[0] for t in titles(streamed)} == {1, 2}


def test_one_file_per_batch_and_restart(spark, tmp_path):
    landing, seen = str(tmp_path / "landing"), []
    for n in range(3):
        spark.createDataFrame([(n, f"http://a/{n}", "x")], "page_id long, url string, html string").coalesce(
            1).write.mode("append").parquet(landing)

    def work(pages, batch):
        seen.append((batch, pages.count()))

    stream = page_stream(spark, landing, files_per_batch=1)
    poll(stream, work, str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == [(1, 1), (2, 1), (3, 1)]
    poll(page_stream(spark, landing), work, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(seen) == 3


@pytest.mark.parametrize("files", [0, 1, 3])
def test_page_table_of_many_files(spark, tmp_path, files):
    """A table may be a folder of files, of none too."""
    rows = [(n, f"http://a/{n}", "x" * n) for n in range(9)] if files else []
    spark.createDataFrame(rows, PAGE).repartition(max(1, files)).write.parquet(str(tmp_path / "pages.parquet"))
    if not files:
        for file in (tmp_path / "pages.parquet").glob("*.parquet"):
            file.unlink()
    found = QUERIES["stream_pages"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(n, "a", len(html)) for n, _, html in rows]


def land(spark, pages, landing):
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(landing)


def test_pages_in_any_order_and_other_writers(spark, tmp_path):
    """Lists, info pages and chapters land one after the other, in a catalog that has been harvested into before."""
    rules, landing = sites.book_rules(spark), str(tmp_path / "landing")
    whole, polled = (Catalog.create(spark, str(tmp_path / n)) for n in ("whole", "polled"))
    old = spark.createDataFrame([(0, "http://b.example/x", "x")], "page_id long, url string, html string")
    harvest_books(polled, rules, old, polled.claim("first"), writer="first")
    pages = sites.book_pages(spark)
    kind = F.when(F.col("url").contains("list"), 0).when(F.col("url").rlike("/[a-z]+[.]html$"), 1).otherwise(2)
    for n in range(3):
        pages.where(kind == n).coalesce(1).write.mode("append").parquet(landing)
        poll_books(polled, rules, landing, str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()
    harvest_books(whole, rules, pages, 1)
    assert [t[1:] for t in titles(polled)] == [t[1:] for t in titles(whole)]
    assert sorted(polled.commits()) == [0, 1, 2, 3, 4]


@pytest.fixture
def texts_read(monkeypatch):
    """Pages whose text was read, by pass: (keys of links that were opened with text)."""
    read = []
    plain = Site.open

    def spying(self, links, *columns):
        if "html" in columns:
            read.extend((r["rule"], r["key"]) for r in links.select("rule", "key").collect())
        return plain(self, links, *columns)

    monkeypatch.setattr(Site, "open", spying)
    return read


def test_a_pass_reads_what_changed_and_what_hangs_on_it(spark, tmp_path, texts_read):
    """Forty books are known; a new chapter of one of them, and a chapter that was missing, are what a pass reads."""
    def crawl(chapters):
        items = "".join(sites.item("li", f"/{b}.html", f"book {b}") for b in range(40))
        pages = {"/list1.html": items}
        for b in range(40):
            n = chapters.get(b, 2)
            listed = "".join(sites.item("dd", f"/{b}/{c}.html", f"c{c}") for c in range(n))
            pages[f"/{b}.html"] = sites.info(f"book {b}", "a", "x", chapters=listed)
            pages |= {f"/{b}/{c}.html": sites.chapter(f"c{c}", f"text {b} {c}") for c in range(n)}
        return pages

    def frame(pages, first):
        return spark.createDataFrame([(first + i, f"http://b.example{u}", h) for i, (u, h) in enumerate(pages.items())], PAGE)

    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    rules = sites.book_rules(spark)
    polled, batched = (Catalog.create(spark, str(tmp_path / n)) for n in ("polled", "batched"))
    before = crawl({})
    del before["/7/1.html"]  # lands later
    later = crawl({3: 3})
    new = {u: later[u] for u in ("/3.html", "/3/2.html", "/7/1.html")}
    land(spark, frame(before, 0), landing)
    poll_books(polled, rules, landing, checkpoint).awaitTermination()
    texts_read.clear()
    land(spark, frame(new, 1000), landing)
    poll_books(polled, rules, landing, checkpoint).awaitTermination()
    # The pages that landed, and the info pages of the two books; each at most at three levels.  Of 121 known pages no other.
    read = {key.removeprefix("http://b.example") for _, key in texts_read}
    assert read == {"/3.html", "/3/2.html", "/7.html", "/7/1.html"} and len(texts_read) <= 3 * len(read)
    for n, pages in enumerate((frame(before, 0), frame(before | new, 1000)), start=1):
        harvest_books(batched, rules, pages, n)
    assert titles(polled) == titles(batched) and len(titles(polled)) == 81
    contents = lambda c: sorted(r["content"] for r in c.table("chapter_content").collect())
    assert contents(polled) == contents(batched)


def test_a_changed_rule_has_no_past(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    catalog = Catalog.create(spark, str(tmp_path / "catalog"))
    land(spark, sites.book_pages(spark), landing)
    poll_books(catalog, sites.book_rules(spark, ContentRule="<no>(?<title>x)"), landing, checkpoint).awaitTermination()
    assert not titles(catalog)
    land(spark, spark.createDataFrame([(99, "http://b.example/else", "")], PAGE), landing)
    poll_books(catalog, sites.book_rules(spark), landing, checkpoint).awaitTermination()
    assert len(titles(catalog)) == 5


def test_missing_chapters_are_tried_three_times(spark, tmp_path):
    """Chapter 二 is missing in two passes and lands in the third; another page never lands."""
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    catalog, rules = Catalog.create(spark, str(tmp_path / "catalog")), sites.book_rules(spark)
    entry = lambda url: [tuple(r) for r in catalog.ledger().where(F.col("url") == url).select("attempts", "state").collect()]
    late, never = "http://b.example/b/2.html", "http://b.example/none.html"
    land(spark, sites.book_pages(spark), landing)
    other = lambda n: spark.createDataFrame([(100 + n, f"http://b.example/other{n}", "")], PAGE)
    seen = []
    for n in range(5):
        poll_books(catalog, rules, landing, checkpoint).awaitTermination()
        seen.append((entry(late), entry(never), len(titles(catalog))))
        land(spark, spark.createDataFrame([(200, late, sites.chapter("二", "b two"))], PAGE) if n == 1 else other(n), landing)
    assert seen == [([(1, "open")], [(1, "open")], 5), ([(2, "open")], [(2, "open")], 5), ([(2, "done")], [(3, "given up")], 7),
                    ([(2, "done")], [(3, "given up")], 7), ([(2, "done")], [(3, "given up")], 7)]


def test_polled_files_are_decoded_by_the_charset_of_the_rule(spark, tmp_path):
    import urllib.parse

    landing = tmp_path / "landing"
    landing.mkdir()
    pages = sites.book_pages(spark, without=())
    for r in pages.where("page_id >= 0").collect():
        (landing / urllib.parse.quote(r.url, safe="")).write_bytes(r.html.encode("gb18030"))
    catalog = Catalog.create(spark, str(tmp_path / "catalog"))
    poll_books(catalog, sites.book_rules(spark, CharSet="gb2312"), str(landing), str(tmp_path / "checkpoint"), raw=True).awaitTermination()
    got = sorted(tuple(r) for r in catalog.table("chapter_content").select("chapter_id", "content").collect())
    assert got == [(1, "b one"), (2, "b one more"), (3, "一&二三"), (4, "abx"), (5, "third")]


def test_polled_series_equal_a_batch(spark, tmp_path):
    rules, landing = sites.series_rules(spark), str(tmp_path / "landing")
    polled, whole = (Catalog.create(spark, str(tmp_path / n)) for n in ("polled", "whole"))
    for c in (polled, whole):
        c.commit(1, {"series": spark.createDataFrame([(7, "怀旧老片集", "")], "id bigint, title string, face_image string")}, "old")
    pages = sites.series_pages(spark)
    for n in range(2):
        land(spark, pages.where(F.pmod(F.xxhash64("url"), F.lit(2)) == n), landing)
        poll_series(polled, rules, landing, str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()
    harvest_series(whole, rules, pages, 2)
    episodes = lambda c: sorted(tuple(r) for r in c.table("episode").select("kind", "movie_title", "title", "url").collect())
    assert episodes(polled) == episodes(whole) and episodes(polled)
