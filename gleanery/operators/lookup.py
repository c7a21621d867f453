"""Harvested rows against the stored catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gleanery.functions.text import trim_dots
from gleanery.functions.urls import url_key
from gleanery.operators.skew import first_per_key, is_small, lookup_join, relevant, salted_join
from gleanery.session import write_out


def filled_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys hold '' instead of null: an absent author equals an absent author."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys})


def exclude(items: DataFrame, blacklist: DataFrame, on: str, spread_by: Sequence[str]) -> DataFrame:
    """Items whose key is not on the list."""
    return lookup_join(items, blacklist.select(on).distinct(), [on], "left_anti", spread_by)


def first_stored(rows: DataFrame, stored: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                 id_name: str = "stored_id") -> DataFrame:
    """Every row with the lowest id stored under its key, null if there is none."""
    rows, stored = filled_keys(rows, on), filled_keys(stored.select("id", *on), on)
    keys = rows.select(*on).distinct()
    small = is_small(keys)
    if small:
        stored = stored.join(F.broadcast(keys), list(on), "left_semi")
    ids = stored.groupBy(*on).agg(F.min("id").alias(id_name))
    # There are at most as many ids as keys.
    return rows.join(F.broadcast(ids), list(on), "left") if small else salted_join(rows, ids, on, "left", spread_by)


def attach_parent(rows: DataFrame, parents: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Copy parent columns into the child rows."""
    return lookup_join(rows, parents, [key], "inner", spread_by)


def substrings(stored: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, short_title) for every distinct substring of a wanted length."""
    sizes = lengths.agg(F.collect_set("n").alias("sizes")).scalar()
    by_size = stored.select("id", "title", F.explode(sizes).alias("n")).where(F.col("n") <= F.length("title"))
    starts = F.sequence(F.lit(1), F.length("title") - F.col("n") + 1)
    pieces = F.transform(starts, lambda i: F.substring("title", i, F.col("n")))
    return by_size.select("id", F.explode(F.array_distinct(pieces)).alias("short_title"))


# Bits of the map of wanted titles that meets the substrings of a large batch: 16 MB, broadcast in pieces of 4 KB.
MAP_BITS = 1 << 27


def mapped(rows: DataFrame, wanted: DataFrame, column: str, bits: int = MAP_BITS) -> DataFrame:
    """Rows whose ``column`` may be among the ``wanted`` ones: all that are, and few that are not.

    The map has a bit for the hash of each wanted value; its size is fixed, however many there are.
    """
    spot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    pieces = wanted.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    place = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.withColumn("_piece", F.bitmap_bucket_number(spot)).join(F.broadcast(pieces), "_piece")
    return near.where(F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1).drop("_piece", "_bits")


def contains_match(harvested: DataFrame, stored: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(title, short_title, id, stored_title): first stored title that contains
    the harvested one without its trailing dots.

    A title contains another exactly if one of its substrings equals it, so
    this is an equi join: work grows with the catalog, not with the product.
    A small batch is broadcast and meets the substrings where they arise; of a large one a map of bits
    is, so that the substrings that are shuffled are hits, and few others.
    """
    asked = harvested.select("title").distinct().withColumn("short_title", trim_dots(F.col("title")))
    asked = asked.where("short_title <> ''")
    wanted = asked.select("short_title").distinct()
    pieces = substrings(stored, wanted.select(F.length("short_title").alias("n")).distinct())
    titles = stored.select("id", F.col("title").alias("stored_title"))
    if is_small(wanted) if broadcast is None else broadcast:
        pieces = pieces.join(F.broadcast(wanted), "short_title", "left_semi")
        first = pieces.groupBy("short_title").agg(F.min("id").alias("id"))
        # There are at most as many hits as wanted titles.
        found = titles.join(F.broadcast(first), "id")
    else:
        # An inner join stays above the aggregate, which shrinks hot substrings first.
        first = mapped(pieces, wanted, "short_title").groupBy("short_title").agg(F.min("id").alias("id")).join(wanted, "short_title")
        found = salted_join(write_out(first, "first-hits"), titles, ["id"], "inner", ["short_title"])
    return asked.join(found, "short_title").select("title", "short_title", "id", "stored_title")


def new_rows(candidates: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str],
             dedup_batch: bool = True) -> DataFrame:
    """Candidates whose key is not stored yet; of equal ones in the batch the first.

    The keys of the candidates are read twice, so these should be a written table.
    """
    known = relevant(stored.select(*keys), candidates, keys).distinct()
    if dedup_batch:
        return first_per_key(candidates, keys, order).join(known, list(keys), "left_anti")
    return salted_join(candidates, known, keys, "left_anti", order)


def follow(links: DataFrame, pages: DataFrame, spread_by: Sequence[str], how: str = "inner") -> DataFrame:
    """Links (with ``link``) joined with the pages they point to.

    ``pages`` has one row per URL.  The result has the page's columns with the
    prefix ``to_``.
    """
    target = pages.select(url_key(F.col("url")).alias("_url"), *[F.col(c).alias(f"to_{c}") for c in pages.columns])
    keyed = links.withColumn("_url", url_key(F.col("link")))
    return salted_join(keyed, target, ["_url"], how, spread_by).drop("_url")
