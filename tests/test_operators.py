from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import sites
from gleanery.operators import chains, extract, incremental, lookup, quarantine, skew
from gleanery.sources import pages as page_source
from gleanery.sources import wordlists
from gleanery.sources.rules import BOOK, SERIES, compile_rules, read_rules, write_rules


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# ----------------------------------------------------------------- extraction

def test_repeated_group_takes_the_last_filled(spark):
    df = spark.createDataFrame([("<a>1<b>2;<a>3<b>;",)], "t string")
    got = df.select(F.explode(extract.all_matches(F.col("t"), "<a>(?<c>[0-9])<b>(?<c>[0-9]?);", ["c", "none"])))
    assert [tuple(r["col"]) for r in got.collect()] == [("2", ""), ("3", "")]


@pytest.mark.parametrize("pattern", [r"(?<k>[a-z]+)=(?<v>[0-9]*)", r"(?<k>[a-z]+)=(?<v>[0-9]*)(?=;)", r"(?<!x)(?<k>[a-z])=(?<v>\d)"])
def test_literal_and_column_patterns_agree(spark, pattern):
    rules = compile_rules(sites.book_rules(spark, ListRule=pattern), BOOK)
    df = spark.createDataFrame([("a=1;b=;xc=3 d=4;",), ("",), (None,)], "t string").withColumn("Name", F.lit("books"))
    df = df.join(rules.select("Name", "ListRule"), "Name")
    literal = df.select(extract.all_matches(F.col("t"), pattern, ["v", "k"])).collect()
    column = df.select(extract.all_matches(F.col("t"), F.col("ListRule"), ["v", "k"])).collect()
    assert literal == column
    first = df.select(extract.first_match(F.col("t"), pattern, ["v", "k"])).collect()
    assert first == df.select(extract.first_match(F.col("t"), F.col("ListRule"), ["v", "k"])).collect()


def test_lookaround_patterns_see_the_whole_text(spark):
    df = spark.createDataFrame([("a1b2c",)], "t string")
    assert df.select(extract.all_matches(F.col("t"), r"(?<d>[0-9])(?=c)", ["d"])).first()[0] == [("2",)]
    assert df.select(extract.first_match(F.col("t"), r"(?<d>[0-9])(?=c)", ["d"])["d"]).first()[0] == "2"


def test_empty_pattern_gives_nothing(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    got = df.select(extract.all_matches(F.col("t"), "", ["x"]), extract.first_match(F.col("t"), "", ["x"])["matched"],
                    extract.is_match(F.col("t"), "")).first()
    assert tuple(got) == ([], False, False)


def test_bad_pattern_is_reported_not_raised(spark):
    rules = compile_rules(sites.book_rules(spark, ListRule="(?<a>[", InfoRule="x"), BOOK)
    got = rules.select(extract.pattern_error(["InfoRule", "ListRule"]), "InfoRule.java", "ListRule.java").first()
    assert tuple(got) == ("bad_pattern:ListRule", "(?d)x", "")


# -------------------------------------------------------------- E1, E2 and ids

LIST = ["一", "二", "三", "二", "", "四"]


def place(titles, wanted):
    """Where the first of some titles stands, behind the end without one."""
    return min((i for i, t in enumerate(titles) if t in wanted), default=len(titles))


def after_last(titles, last_id, last):
    """All titles without a last id; else those after the last title, if it is there and no empty title stands before it."""
    cut = place(titles, {last})
    return titles if not last_id else titles[cut + 1:] if cut < place(titles, {""}) else []


def test_resume_and_take_against_loops(spark):
    rng = random.Random(7)
    lists, parents, known = [], [], []
    want_resume, want_both = [], []
    for book in range(120):
        titles = [rng.choice(["一", "二", "三", "四", "五", ""] if rng.random() < 0.3 else list("abcdefgh"))
                  for _ in range(rng.randrange(0, 9))]
        last_id, last = rng.choice([None, 0, 5, 6, 7]), rng.choice(["一", "a", "c", "zz", "", None])
        have = set(rng.sample(["一", "b", "d", "h", "四"], rng.randrange(0, 3)))
        lists += [(book, i, t) for i, t in enumerate(titles)]
        parents.append((book, last_id, last))
        known += [(book, t) for t in have]
        kept = after_last(titles, last_id, last or "")
        want_resume += [(book, t) for t in kept]
        want_both += [(book, t) for t in kept[:place(kept, have | {""})]]
    items = spark.createDataFrame(lists, "book long, pos long, title string")
    parents = spark.createDataFrame(parents, "book long, last_id long, last_title string")
    known = spark.createDataFrame(known, "book long, title string")
    resumed = incremental.resume_after_last(items, parents, "book")
    assert rows(resumed, "book", "title") == sorted(want_resume)
    taken = incremental.take_until_known(resumed, known, "book")
    assert [(r.book, r.title) for r in taken.orderBy("book", "pos").collect()] == want_both


def test_resume_cases(spark):
    items = spark.createDataFrame([(1, i, t) for i, t in enumerate(LIST)], "book long, pos long, title string")

    def resumed(last_id, last):
        parents = spark.createDataFrame([(1, last_id, last)], "book long, last_id long, last_title string")
        return [r[1] for r in rows(incremental.resume_after_last(items, parents, "book"), "pos", "title")]

    assert resumed(0, "二") == LIST and resumed(None, "二") == LIST
    assert resumed(9, "二") == ["三", "二", "", "四"]  # the first of two equal titles counts
    assert resumed(9, "missing") == []
    assert resumed(9, "四") == []  # behind an empty title


def test_ids_are_dense_and_ordered(spark):
    new = spark.range(25000).select(F.format_string("t%05d", F.col("id") * 7 % 25000).alias("title"))
    stored = spark.createDataFrame([(40, "x")], "id bigint, title string")
    got = incremental.assign_ids(new, ["title"], stored).orderBy("title").select("id").collect()
    assert [r[0] for r in got] == list(range(41, 25041))
    few = incremental.assign_ids(new.where("title < 't00003'"), ["title"], stored.limit(0))
    assert rows(few, "id", "title") == [(1, "t00000"), (2, "t00001"), (3, "t00002")]


def test_new_rows_keeps_or_drops_copies(spark):
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("k", 4)], "title string, pos long")
    stored = spark.createDataFrame([("k",), ("k",)], "title string")
    assert rows(lookup.new_rows(batch, stored, ["title"], ["pos"])) == [("a", 1), ("b", 3)]
    assert rows(lookup.new_rows(batch, stored, ["title"], ["pos"], dedup_batch=False)) == [("a", 1), ("a", 2), ("b", 3)]


def test_lookup_treats_null_as_empty(spark):
    harvested = spark.createDataFrame([(1, "t", None), (2, "t", "x")], "n long, title string, author string")
    stored = spark.createDataFrame([(9, "t", ""), (4, "t", None)], "id long, title string, author string")
    assert lookup.first_stored(harvested, stored, ["title", "author"], ["n"]).orderBy("n").select("stored_id").collect() == [
        (4,), (None,)]


# ------------------------------------------------------------- contains match

@pytest.mark.parametrize("broadcast", [True, False])
def test_contains_match_against_loops(spark, broadcast):
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("ab中 ") for _ in range(n))

    stored = [(i, word(rng.randrange(0, 14))) for i in range(400)] + [(1000, "中b"), (999, "中b")]
    asked = [word(rng.randrange(1, 7)) + "." * rng.randrange(0, 3) for _ in range(150)] + ["...", "", "中b", "中b.."]
    want = set()
    for a in asked:
        short = a.rstrip(".")
        hits = [(i, t) for i, t in stored if short and short in t]
        if hits:
            want.add((a, short, *min(hits)))
    got = lookup.contains_match(spark.createDataFrame([(a,) for a in asked], "title string"),
                                spark.createDataFrame(stored, "id long, title string"), broadcast=broadcast)
    assert set(rows(got)) == want and got.count() == len(want)


# ----------------------------------------------------------------------- skew

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
                                    .otherwise((F.col("id") % 50).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3), ("2", 4), ("none", 5), (None, 6)], "k string, v long")
    salted = skew.salted_join(left, right, ["k"], how, ["id"], hot_rows=100)
    plain = left.join(right, ["k"], how)
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_split_over_tasks(spark):
    left = spark.range(40000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(40000).select(F.col("id").alias("k"), F.lit("x" * 10).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = skew.salted_join(left, right, ["k"], "inner", ["id"], hot_rows=500)
        sizes = joined.groupBy(F.spark_partition_id()).count().select("count").collect()
        assert joined.count() == 40000 and max(s[0] for s in sizes) < 5000
    finally:
        for key in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_size_check_and_relevant(spark):
    assert skew.is_small(spark.range(10), 10) and not skew.is_small(spark.range(11), 10)
    assert not skew.is_small(spark.range(10).select(F.lit("x" * 1000)), 10, 500)
    stored = spark.range(100).withColumnRenamed("id", "k")
    assert skew.relevant(stored, spark.createDataFrame([(5,), (5,), (500,)], "k long"), ["k"]).collect() == [(5,)]


def test_first_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    plan = skew.first_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert rows(skew.first_per_key(df, ["k"], ["id"])) == [(0, 0), (1, 1), (2, 2)]


# --------------------------------------------------------------------- chains

def brute_walk(seeds, edges):
    out = []
    for seed, node in seeds:
        seen = []
        while node is not None and node not in seen:
            seen.append(node)
            node = edges.get(node)
        out += [(seed, n, i) for i, n in enumerate(seen)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["line", "loop", "random"])
def test_walk_against_loops(spark, shape):
    rng = random.Random(5)
    if shape == "line":
        edges, seeds = {i: i + 1 for i in range(200)}, [(0, 0), (1, 150), (2, 200), (3, 999)]
    elif shape == "loop":
        edges, seeds = {**{i: i + 1 for i in range(20)}, 20: 7, 30: 30}, [(0, 0), (1, 10), (2, 30)]
    else:
        edges, seeds = {i: rng.randrange(60) for i in range(50)}, [(i, rng.randrange(60)) for i in range(25)]
    got = chains.walk(spark.createDataFrame(seeds, "seed long, node long"),
                      spark.createDataFrame(list(edges.items()), "node long, next long"))
    assert rows(got, "seed", "node", "step") == brute_walk(seeds, edges)


def test_walk_with_a_bound(spark):
    edges = spark.range(50).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    seeds = spark.createDataFrame([(0, 0)], "seed long, node long")
    assert chains.walk(seeds, edges, max_steps=10).count() == 11


def test_stitch_gives_one_text_per_chain(spark):
    parts = spark.createDataFrame([(1, i, str(i % 10)) for i in range(25)], "k long, step long, text string")
    assert rows(chains.stitch(parts, ["k"])) == [(1, 25, "0123456789" * 2 + "01234")]


def test_own_or_linked(spark):
    own = spark.createDataFrame([(1, "own1"), (2, "own2")], "k long, html string")
    linked = spark.createDataFrame([(2, "linked2")], "k long, html string")
    assert rows(chains.own_or_linked(own, linked, "k"), "k", "html") == [(1, "own1"), (2, "linked2")]


# ---------------------------------------------------------- pages, quarantine

def test_latest_page_counts(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "old"), (5, "HTTP://A:80/x#f", "new"), (2, "http://a/y", "y")],
                                  "page_id long, url string, html string")
    assert rows(page_source.latest_pages(pages), "page_id") == [(2,), (5,)]


def test_copies_of_a_page_with_one_id_count_once(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "old"), (5, "http://a/x", "same"), (5, "http://a:80/x", "same"),
                                   (5, "http://a/y", "y")], "page_id long, url string, html string")
    assert rows(page_source.latest_pages(pages), "page_id", "html") == [(5, "same"), (5, "y")]


@pytest.mark.parametrize("legacy", ["true", "false"])
def test_charsets(spark, legacy):
    raw = spark.createDataFrame([
        (1, "gb2312", bytearray("中文".encode("gb2312"))), (2, "utf-8", bytearray("é".encode())),
        (3, "", bytearray(b"x")), (4, "utf-16", bytearray("é".encode("utf-16"))),
        (5, "GB2312", bytearray("镕".encode("gbk"))), (6, "utf-8", bytearray(b"a\xffb")), (7, "no-such", bytearray(b"x")),
        (8, "us-ascii", bytearray(b"a\xe9b")), (9, None, None)], "id long, charset string, content binary")
    spark.conf.set("spark.sql.legacy.javaCharsets", legacy)
    try:
        assert rows(page_source.decode_pages(raw), "id", "html") == [
            (1, "中文"), (2, "é"), (3, "x"), (4, "é"), (5, "镕"), (6, "a\ufffdb"), (7, None), (8, "a\ufffdb"), (9, None)]
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("中".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"no")
    raw = page_source.read_raw(spark, str(tmp_path)).withColumn("charset", F.lit("gb2312"))
    assert [r.html for r in page_source.decode_pages(raw).collect()] == ["中"]


def test_too_long_rows_are_set_aside(spark):
    rows_ = spark.createDataFrame([("qvod", "x" * 51, "m", "u"), ("baidu", "x" * 51, "m", "u"), ("baidu", "x" * 256, "m", "u")],
                                  "kind string, title string, movie_title string, url string")
    good, bad = quarantine.fitting(rows_, "episode")
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"too_long:title"}


def test_retry_ends_after_three_tries(spark):
    tries = spark.createDataFrame([("c", "r", "a", 1), ("c", "r", "a", 1), ("c", "r", "b", 3), ("c", "r", "b", 1)],
                                  "step string, rule string, url string, attempts int")
    assert rows(quarantine.retry(tries), "url", "attempts") == [("a", 2)]


def test_rules_side_is_broadcast_and_text_stays_home(spark):
    pages = spark.createDataFrame([(1, "http://b.example/x", "t")], "page_id long, url string, html string")
    rules = compile_rules(sites.book_rules(spark), BOOK).withColumnRenamed("SiteDomain", "host")
    joined = page_source.rule_pages(page_source.with_host(pages), rules.select("host", "ListRule"))
    plan = extract.explode_matches(joined, ["page_id"], extract.all_matches(F.col("html"), F.col("ListRule"), ["url"]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_pre_aggregation_stays_below_the_join(spark):
    """Copies of a title are reduced before the join with the known titles."""
    items = spark.range(100).select((F.col("id") % 2).alias("book"), F.col("id").alias("pos"), F.lit("t").alias("title"))
    known = spark.range(5).select(F.col("id").alias("book"), F.lit("t").alias("title"))
    plan = incremental.take_until_known(items, known, "book")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    assert incremental.take_until_known(items, known, "book").count() == 0


def test_group_names_are_the_record(spark):
    df = spark.createDataFrame([("a=1 b=2",)], "t string")
    got = df.select(F.explode(extract.all_matches(F.col("t"), r"(?<name>[a-z])=(?<size>[0-9])")).alias("r")).select("r.*")
    assert got.columns == ["name", "size"] and rows(got) == [("a", "1"), ("b", "2")]


def test_rule_files(spark, tmp_path):
    """One rule per file, with a byte order mark, a namespace and empty elements."""
    xml = ('<?xml version="1.0" encoding="utf-8"?>\n<MovieRule xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">\n'
           "  <Name>某影院</Name><IsMovie>false</IsMovie><Encoding>gb2312</Encoding>\n"
           '  <ListInfoRule>&lt;a href="(?&lt;url&gt;.*?)"&gt;(?&lt;title&gt;.*?)&lt;/a&gt;&amp;nbsp;</ListInfoRule>\n'
           "  <KuaibAreaRule />\n</MovieRule>")
    (tmp_path / "a.xml").write_bytes(b"\xef\xbb\xbf" + xml.encode())
    (tmp_path / "b.txt").write_text(xml.replace("某影院", "b"))
    got = read_rules(spark, str(tmp_path), SERIES)
    assert rows(got, "Name", "IsMovie", "Encoding", "KuaibAreaRule", "InfoRule", "ListInfoRule") == [
        ("某影院", False, "gb2312", "", "", '<a href="(?<url>.*?)">(?<title>.*?)</a>&nbsp;')]
    assert read_rules(spark, str(tmp_path), SERIES, glob="*").count() == 2


def test_rules_survive_a_round_trip(spark, tmp_path):
    rules = sites.book_rules(spark).na.fill("")
    write_rules(rules, str(tmp_path / "out"), BOOK)
    assert read_rules(spark, str(tmp_path / "out"), BOOK, glob="*").collect() == rules.collect()


def test_blacklist_file(spark, tmp_path):
    (tmp_path / "blacklist.txt").write_bytes("甲\r\n\r\n乙\n".encode())
    listed = wordlists.blacklist(wordlists.read_lines(spark, str(tmp_path / "blacklist.txt")))
    items = spark.createDataFrame([("甲", 1), ("乙", 2), ("丙", 3)], "title string, n long")
    assert rows(lookup.exclude(items, listed, "title", ["n"])) == [("丙", 3)]
