"""Walks over next links: where they start, what they read, what they move."""

from __future__ import annotations

import io
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import sites
from gleanery.functions.urls import host
from gleanery.operators import chains, extract
from gleanery.plans.site import NextLinks, Site
from gleanery.schemas import PAGE
from gleanery.session import write_out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def brute_first(starts, following):
    best = {}
    for group, node, rank in starts:
        step, seen = 0, set()
        while node is not None and node not in seen:
            seen.add(node)
            at = best.get((group, node))
            best[group, node] = min(at, (rank, step)) if at else (rank, step)
            node, step = following.get(node), step + 1
    return sorted((g, n, *at) for (g, n), at in best.items())


@pytest.mark.parametrize("order", ["forward", "reverse", "shuffled"])
def test_a_page_counts_from_its_first_start(spark, order):
    """Every page of a chain is a start: as many rows as pages, in whatever order the list has them."""
    n = 60
    places = {"forward": list(range(n)), "reverse": list(range(n))[::-1], "shuffled": random.Random(1).sample(range(n), n)}[order]
    starts = [("a", i, places[i]) for i in range(n)] + [("b", 30, 7), ("b", 10, 9)]
    following = {i: i + 1 for i in range(n - 1)}
    reached = chains.first_reach(spark.createDataFrame(starts, "group string, node long, rank long"),
                                 spark.createDataFrame(list(following.items()), "node long, next long"))
    assert rows(reached, "group", "node", "rank", "step") == brute_first(starts, following)
    assert reached.where("group = 'a'").count() == n


def test_first_starts_on_any_graph(spark):
    random.seed(3)
    for _ in range(3):
        n = random.randint(2, 40)
        following = {i: random.randrange(n) for i in range(n) if random.random() < 0.9}  # trees, loops, ends
        starts = [(random.choice("ab"), random.randrange(n), random.randrange(20)) for _ in range(random.randint(1, 25))]
        reached = chains.first_reach(spark.createDataFrame(starts, "group string, node long, rank long"),
                                     spark.createDataFrame(list(following.items()), "node long, next long"))
        assert rows(reached, "group", "node", "rank", "step") == brute_first(starts, following)


def site_of(spark, pages):
    rules = spark.createDataFrame([("r", '<a next="(?<key>.*?)">')], "rule string, Next string")
    rules = write_out(extract.compile_patterns(rules, ["Next"]).withColumn("_charset", F.lit("")), "rules")
    table = spark.createDataFrame([(i, u, f'<a next="{n}">' if n else "end") for i, (u, n) in enumerate(pages.items())], PAGE)
    return Site.of(table, rules)


def links_of(spark, site):
    return NextLinks(site, {"next": extract.next_link(F.col("html"), F.col("Next"), F.col("url"))},
                     spark.createDataFrame([("r", "home.example")], "rule string, host string"))


def seeds(spark, *urls):
    return spark.createDataFrame([(u, "r", u) for u in urls], "seed string, rule string, key string")


def test_a_link_to_a_huge_host_costs_a_page(spark):
    huge = {f"http://huge.example/{i}": f"http://huge.example/{i + 1}" for i in range(100, 400)}
    pages = {"http://home.example/1": "http://home.example/2", "http://home.example/2": "http://huge.example/1",
             "http://huge.example/1": None, "http://home.example/unreached": "http://huge.example/100", **huge}
    site = site_of(spark, pages)
    onward = links_of(spark, site)
    reached = onward.walk(seeds(spark, "http://home.example/1"), "next")
    assert rows(reached, "key", "step") == [("http://home.example/1", 0), ("http://home.example/2", 1), ("http://huge.example/1", 2)]
    assert (onward.read_at_home, onward.read_ahead) == (3, 1)
    # A second walk reads nothing again.
    assert onward.walk(seeds(spark, "http://home.example/2"), "next").count() == 2
    assert (onward.read_at_home, onward.read_ahead) == (3, 1)


def test_a_walk_ahead_reads_what_it_reaches_and_one_miss(spark):
    chain = {f"http://b.example/{i}": f"http://b.example/{i + 1}" for i in range(5)}
    rest = {f"http://b.example/x{i}": f"http://b.example/x{i + 1}" for i in range(500)}
    site = site_of(spark, {"http://home.example/1": "http://b.example/0", **chain, **rest})
    onward = links_of(spark, site)
    reached = onward.walk(seeds(spark, "http://home.example/1"), "next")
    assert reached.count() == 7  # with the missing page at the end
    assert onward.read_at_home == 1 and onward.read_ahead == 6


def test_a_long_chain_makes_a_host_its_own(spark):
    """Rounds grow with the logarithm of the host, not with the chain."""
    chain = {f"http://b.example/{i}": f"http://b.example/{i + 1}" for i in range(40)}
    site = site_of(spark, {"http://home.example/1": "http://b.example/0", **chain})
    onward = links_of(spark, site)
    assert onward.walk(seeds(spark, "http://home.example/1"), "next").count() == 42
    assert onward.read_ahead <= 7 and onward.read_at_home == 41


def test_walks_lead_home_again(spark):
    pages = {"http://home.example/1": "http://b.example/0", "http://b.example/0": "http://home.example/2",
             "http://home.example/2": "http://c.example/0", "http://c.example/0": "http://home.example/1"}
    onward = links_of(spark, site_of(spark, pages))
    assert rows(onward.walk(seeds(spark, "http://home.example/1"), "next"), "step") == [(0,), (1,), (2,), (3,)]
    assert onward.read_ahead == 2


def exchanges(df):
    """Columns that the exchanges of a plan move."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    text = out.getvalue()
    return re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)\s*\n(?:Input|Output)[^\n]*: \[([^\n]*)\]", text), text


def test_levels_move_links_only(spark):
    """Beyond the bound of a broadcast, links go to the pages' buckets; no exchange holds page text."""
    pages = spark.range(12_000).select("id", F.format_string("http://home.example/%d", "id").alias("url"), F.lit("text").alias("html"))
    rules = write_out(spark.createDataFrame([("r", "")], "rule string, _charset string"), "rules")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        site = Site.of(pages.withColumnRenamed("id", "page_id"), rules)
        links = write_out(site.pages.select(F.lit("r").alias("rule"), "key"), "links")
        opened = site.open(links, "html")
        moved, plan = exchanges(opened)
        assert "Bucketed: true" in plan and moved and not any(re.search("html|content", columns) for columns in moved)
        assert opened.where("found").count() == 12_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_links_that_many_rows_hold(spark, monkeypatch):
    from gleanery.operators import skew
    from gleanery.plans import site as site_module

    monkeypatch.setattr(site_module, "is_small", lambda df, *a: "key" not in df.columns)
    monkeypatch.setattr(site_module, "hot_keys", lambda df, on: skew.hot_keys(df, on, 5))
    pages = {f"http://home.example/{i}": None for i in range(4)}
    site = site_of(spark, pages)
    links = spark.createDataFrame([("r", f"http://home.example/{k}", i) for i in range(60) for k in (0, 9)]
                                  + [("r", "http://home.example/1", 99)], "rule string, key string, n int")
    opened = site.open(links, "html")
    assert opened.count() == 121 and opened.where("found").count() == 61


def test_hosts_of_seeds(value):
    assert value(host, "http://Home.example:80/x") == "home.example"
