"""What both jobs share: a crawl pass seen through the rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions.urls import host, url_key
from gleanery.operators import chains, extract, quarantine
from gleanery.operators.skew import first_per_key, hot_keys, is_small, lookup_join, salted_join
from gleanery.plans.memory import Memory
from gleanery.session import counted, write_bucketed, write_out
from gleanery.sources import pages as page_source
from gleanery.sources.rules import CHARSETS, PATTERNS, compile_rules

# A page as a rule sees it.
PAGE_ID = ["rule", "key"]
# Hashes of links that may be broadcast to find their pages: 8 MB.
MOST_HASHES = 1 << 20


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def set_aside(rows: DataFrame, step: str, reason: Column | str, url: str = "url") -> DataFrame:
    """Quarantine rows of a step."""
    title = F.col("title") if "title" in rows.columns else F.lit("")
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return quarantine.as_quarantine(
        rows.select("rule", F.col(url).alias("url"), title.alias("title"), reason.alias("reason")), step)


def is_raw(pages: DataFrame) -> bool:
    """Whether pages come as bytes (``content``), to be decoded by the charset of the rule that reads them."""
    return "html" not in pages.columns


def usable_rules(rules: DataFrame, kind: str, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(compiled rules, rules with a bad pattern or, for raw pages, an unknown charset): one bad rule stops no other."""
    field = CHARSETS[kind]
    bad_charset = F.when(F.lit(is_raw(pages)) & ~page_source.is_charset(F.col(field)), f"bad_charset:{field}")
    compiled = compile_rules(rules.na.fill(""), kind).withColumn(
        "reason", F.coalesce(extract.pattern_error(PATTERNS[kind]), bad_charset))
    compiled = write_out(compiled.withColumn("_charset", F.col(field)), "rules").withColumnRenamed("Name", "rule")
    return compiled.where("reason is null").drop("reason"), compiled.where("reason is not null")


@dataclass(frozen=True)
class Site:
    """The pages of a pass, one per URL, and the rules (with ``rule``).

    The pages of a pass are dealt out by their key once; after that a level moves its links only, never page text.  The
    pages of a poll lie in its memory, where a URL may have several; of these the newest counts.
    """

    pages: DataFrame
    rules: DataFrame
    small: bool
    memory: Memory | None = None

    @classmethod
    def of(cls, pages: DataFrame, rules: DataFrame, memory: Memory | None = None) -> Site:
        if memory is not None:
            memory.begin(pages, rules)
            return cls(memory.pages(), rules, is_small(rules), memory)
        keyed = page_source.latest_pages(pages).withColumn("key", url_key(F.col("url")))
        return cls(write_bucketed(keyed, "pages", "key"), rules, is_small(rules))

    def pages_of(self, hosts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
        """Rules with the pages of the hosts that are given for them (rule, host): all pages, or some."""
        pages = self.pages if pages is None else pages
        rules = lookup_join(self.rules, hosts, ["rule"], "inner", ["rule"])
        if is_small(rules) and self.memory is None:
            return self._as_text(page_source.with_host(pages).join(F.broadcast(rules), "host"))
        # Rules and pages are paired by their names; text is read where it lies.
        names = page_source.with_host(pages.select("key", "url", "page_id"))
        pairs = page_source.rule_pages(names, rules.select("rule", "host")).select(*PAGE_ID).distinct()
        return self.open(write_out(pairs, "pairs"), "html", "url", *[c for c in self.rules.columns if c != "rule"]).where("found")

    def _as_text(self, read: DataFrame) -> DataFrame:
        return page_source.decode_pages(read, charset="_charset") if is_raw(self.pages) else read

    def open(self, links: DataFrame, *columns: str) -> DataFrame:
        """Links (rule, key, ...) with the page they point to, whatever its host.

        ``found`` is null if the page is missing.  To look at that alone does
        not read any page text.
        """
        raw = "html" in columns and is_raw(self.pages)
        columns = tuple(dict.fromkeys((*columns, "content", "_charset"))) if raw else columns
        of_page = [c for c in columns if c in self.pages.columns]
        of_rule = [c for c in columns if c in self.rules.columns]
        opened = self._joined(links, of_page)
        opened = self._with_rules(opened, self.rules.select("rule", *of_rule), "rule", links.columns)
        return self._as_text(opened).drop("_charset") if raw else opened

    def _joined(self, links: DataFrame, of_page: list[str]) -> DataFrame:
        pages = self.pages.select("key", F.lit(True).alias("found"), *of_page)
        keys = links.select("key").distinct()
        few = is_small(keys)
        if few:
            # The pages are only scanned.
            pages = self.pages.join(F.broadcast(keys), "key", "left_semi")
        elif self.memory is not None:
            hashes, n = counted(keys.select(F.xxhash64("key").alias("_hash")).distinct(), "hashes")
            pages = self.pages.withColumn("_hash", F.xxhash64("key"))
            pages = pages.join(F.broadcast(hashes) if n <= MOST_HASHES else hashes, "_hash", "left_semi")
        if self.memory is not None:
            pages = first_per_key(pages, ["key"], [F.desc("page_id"), F.desc("pass")])
        pages = pages.select("key", F.lit(True).alias("found"), *of_page)
        if few:
            return links.join(pages, "key", "left")
        # Links to pages that very many links name are dealt out; only those pages are moved.
        hot, n = counted(hot_keys(links, ["key"]).select("_key"), "hot")
        if not n:
            return links.join(pages, "key", "left")
        mark = lambda df: df.withColumn("_key", F.xxhash64("key"))
        cold = mark(links).join(F.broadcast(hot), "_key", "left_anti").drop("_key").join(pages, "key", "left")
        sought = mark(pages).join(F.broadcast(hot), "_key", "left_semi").drop("_key")
        named = mark(links).join(F.broadcast(hot), "_key", "left_semi").drop("_key")
        return cold.unionByName(salted_join(named, sought, ["key"], "left", links.columns))

    def items(self, lists: DataFrame, schema: str, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """(items, missing pages) of list pages (rule, key, step), by ``read``; with a memory, a page is opened once.

        Items have the columns rule, key (of the list page), step and those of ``schema``.
        """
        if self.memory is None:
            return read(lists)
        known = self.memory.recall("lists", "rule string, key string").distinct()
        past = self.memory.recall("items", f"rule string, key string, {schema}")
        fresh = write_out(lists.join(known, PAGE_ID, "left_anti"), "fresh-lists")
        items, missing = read(fresh)
        items, missing = write_out(items, "items"), write_out(missing, "missing")
        self.memory.keep("lists", fresh.select(*PAGE_ID).join(missing.select(*PAGE_ID), PAGE_ID, "left_anti"))
        self.memory.keep("items", items.drop("step"))
        return items.unionByName(lookup_join(past, lists, PAGE_ID, "inner", ["pos"])), missing

    def settle(self, stored: DataFrame, aside: DataFrame) -> DataFrame:
        """Ledger entries of a pass: pages that were missing, and earlier missing ones that are there now."""
        failed = aside.where("reason = 'missing_page'")
        waiting = write_out(stored.where("state <> 'done'").withColumn("key", url_key(F.col("url"))), "waiting")
        return quarantine.merge_ledger(stored, failed, self.open(waiting).where("found"))

    def _with_rules(self, rows: DataFrame, rules: DataFrame, on: str, spread_by: list[str]) -> DataFrame:
        if self.small:
            return rows.join(F.broadcast(rules), on)
        return salted_join(rows, rules, [on], "inner", spread_by)


def edges_of(edges: DataFrame, link: str) -> DataFrame:
    """(node, next) of the next links of one kind."""
    return edges.where(F.col(link).isNotNull()).select(
        F.struct(*PAGE_ID).alias("node"), F.struct("rule", url_key(F.col(link)).alias("key")).alias("next"))


def walk_pages(seeds: DataFrame, edges: DataFrame, link: str) -> DataFrame:
    """(seed, rule, key, step) of the pages reached from ``seeds`` (seed, rule, key)."""
    node = F.struct(*PAGE_ID).alias("node")
    return chains.walk(seeds.select("seed", node), edges_of(edges, link)).select("seed", "node.*", "step")


class NextLinks:
    """The next links of the pages that walks meet.

    ``links`` gives the column of each kind of link, ``home`` the hosts (rule, host) of the rules' own sites, all of whose pages are
    held against their rule at once.  Elsewhere a walk goes by frontiers: a round opens the pages that
    the last round's pages link to and that no earlier round has opened, and no others, so that a link to a host with any number of pages costs
    one.  A chain that has stayed on a host for n rounds, while the host has no more than 2 ** n pages, makes the host
    one of the rule's own: rounds grow with the logarithm of a host.

    With a memory, links of earlier passes are not read again: a pass looks at its own pages, and at known ones that no pass has opened.
    """

    def __init__(self, site: Site, links: dict[str, Column], home: DataFrame) -> None:
        self.site, self.links, self.memory = site, links, site.memory
        self.edges: list[DataFrame] = []
        self.whole: list[DataFrame] = []
        #: Pages whose text was read, by walks on hosts of their own and by frontiers.
        self.read_at_home = self.read_ahead = 0
        home = write_out(home.where("host <> ''").distinct(), "home")
        if self.memory is not None:
            self.edges.append(self.memory.recall("edges", f"rule string, key string, {', '.join(f'{n} string' for n in links)}"))
            known = self.memory.recall("whole", "rule string, host string", fresh=False)
            self.whole.append(known)
            # Of hosts that were read whole only the pages of this pass are new.
            self._take(site.pages_of(known, self.memory.landed()))
            home = write_out(home.join(known, ["rule", "host"], "left_anti"), "home")
        self._adopt(home)

    def walk(self, seeds: DataFrame, link: str) -> DataFrame:
        """``walk_pages`` over the links of one kind."""
        return self._settled(lambda: walk_pages(seeds, stack(self.edges), link), link)

    def first(self, starts: DataFrame, link: str) -> DataFrame:
        """(group, rule, key, rank, step) of the pages that ``starts`` (group, rule, key, rank) reach, each by its first start."""
        nodes = starts.select("group", F.struct(*PAGE_ID).alias("node"), "rank")
        reach = lambda: chains.first_reach(nodes, edges_of(stack(self.edges), link)).select("group", "node.*", "rank", "step")
        return self._settled(reach, link)

    def _take(self, opened: DataFrame, label: str = "edges") -> tuple[DataFrame, int]:
        found, n = counted(opened.select(*PAGE_ID, *[link.alias(name) for name, link in self.links.items()]), label)
        self.edges.append(found)
        if self.memory is not None:
            self.memory.keep("edges", found)
        return found, n

    def _adopt(self, hosts: DataFrame) -> None:
        """Read all pages of some hosts (rule, host), a written table."""
        self.read_at_home += self._take(self.site.pages_of(hosts))[1]
        self.whole.append(hosts)
        if self.memory is not None:
            self.memory.keep("whole", hosts)

    def _settled(self, walked: Callable[[], DataFrame], link: str) -> DataFrame:
        """Walk, open what the walk met and no page is known of, and walk again until it meets no more."""
        while True:
            reached = walked()
            new, n = self._frontier(reached.select(*PAGE_ID))
            if not n:
                return reached
            rounds = 0
            while n:
                found, _ = self._take(self._opened(new))
                self.read_ahead += n
                met = found.where(F.col(link).isNotNull()).select("rule", url_key(F.col(link)).alias("key"))
                rounds += 1
                new, n = self._frontier(met)
                if n:
                    new, n = self._stay_or_adopt(new, n, rounds)

    def _opened(self, new: DataFrame) -> DataFrame:
        """Pages of a frontier; a missing one has no links."""
        columns = [c for c in self.site.rules.columns if c != "rule"]
        return self.site.open(new, "html", "url", *columns)

    def _frontier(self, met: DataFrame) -> tuple[DataFrame, int]:
        """Pages that were not opened and do not lie on a host that was read whole."""
        new = met.distinct().withColumn("host", host(F.col("key")))
        new = new.join(stack(self.whole).distinct(), ["rule", "host"], "left_anti")
        new = new.join(stack(self.edges).select(*PAGE_ID).distinct(), PAGE_ID, "left_anti")
        return counted(new.select(*PAGE_ID), "frontier")

    def _stay_or_adopt(self, new: DataFrame, n: int, rounds: int) -> tuple[DataFrame, int]:
        met = new.select("rule", host(F.col("key")).alias("host")).distinct()
        names = page_source.with_host(self.site.pages.select("key", "url")).join(
            F.broadcast(met.select("host").distinct()) if is_small(met) else met.select("host").distinct(), "host", "left_semi")
        small = names.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") <= 2 ** min(rounds, 62))
        own, many = counted(met.join(small, "host").select("rule", "host"), "adopted")
        if not many:
            return new, n
        self._adopt(own)
        return self._frontier(new)
