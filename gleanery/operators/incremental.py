"""Incremental maintenance of the catalog: what is new, under which id."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.functions import fixed_values as fixed
from gleanery.operators.lookup import filled_keys, new_rows
from gleanery.operators.skew import BROADCAST_ROWS, first_per_key, lookup_join, salted_join
from gleanery.schemas import with_defaults
from gleanery.session import counted, write_out


def _first_positions(items: DataFrame, group: str) -> DataFrame:
    """First position of every title of a group: the pre-aggregated list."""
    return items.groupBy(group, "title").agg(F.min("pos").alias("pos"))


def resume_after_last(items: DataFrame, parents: DataFrame, group: str, rows: int | None = None) -> DataFrame:
    """Items after the last one known.

    ``items`` (group, pos, title), ``parents`` (group, last_id, last_title).  A
    parent without a last item keeps all.  If the title is not in the list, or
    an empty title comes before it, nothing is kept.  ``rows``: see ``salted_join``.
    """
    items = filled_keys(items, ["title"])
    heads = _first_positions(items, group)
    last = parents.select(group, F.coalesce("last_id", F.lit(0)).alias("_last_id"),
                          F.coalesce("last_title", F.lit("")).alias("title"))
    hits = heads.join(last.where("_last_id <> 0"), [group, "title"]).select(group, F.col("pos").alias("_cut"))
    empty = heads.where("title = ''").select(group, F.col("pos").alias("_empty"))
    bounds = (
        last.join(hits, group, "left").join(empty, group, "left")
        .where("_last_id = 0 or _cut < coalesce(_empty, _cut + 1)")
        .select(group, F.when(F.col("_last_id") == 0, -1).otherwise(F.col("_cut")).alias("_cut"))
    )
    kept = salted_join(items, bounds, [group], "inner", ["pos"], rows=rows)
    return kept.where("pos > _cut").drop("_cut")


def take_until_known(items: DataFrame, known: DataFrame, group: str, rows: int | None = None) -> DataFrame:
    """The items of a group before the first that is stored or has no title.

    ``items`` (group, pos, title), ``known`` (group, title).
    """
    items = filled_keys(items, ["title"])
    heads = _first_positions(items, group)
    # An inner join: a semi join would be pushed below the aggregate, to all items.
    stored = heads.join(known.select(group, "title").distinct(), [group, "title"])
    stops = heads.where("title = ''").unionByName(stored).groupBy(group).agg(F.min("pos").alias("_stop"))
    cut = salted_join(items, stops, [group], "left", ["pos"], rows=rows)
    return cut.where("_stop is null or pos < _stop").drop("_stop")


def assign_ids(new: DataFrame, order: Sequence[str], stored: DataFrame, id_name: str = "id") -> DataFrame:
    """Number rows densely in ``order``, on from the highest stored id.

    A few rows are numbered at once.  Many are range-partitioned and written
    out; a partition's first number follows from the sizes of the ones before
    it, so no task sees all rows.
    """
    highest = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("id")).scalar()
    new, count = counted(new, "new")
    if count <= BROADCAST_ROWS:
        return new.withColumn(id_name, F.row_number().over(Window.orderBy(*order)) + highest)
    parts = write_out(new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: bounded by the number of tasks.
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = parts.withColumn("_rank", rank).join(F.broadcast(offsets), "_part")
    numbered = numbered.withColumn(id_name, F.col("_rank") + F.col("_offset") + highest)
    return numbered.drop("_part", "_rank", "_offset")


def get_or_create(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], table: str,
                  order: Sequence[str] | None = None, values: dict[str, Any] | None = None) -> DataFrame:
    """Rows to insert: one per key that is not stored, numbered and completed."""
    fresh = new_rows(filled_keys(wanted, keys), filled_keys(stored, keys), keys, order or list(keys))
    return with_defaults(assign_ids(fresh, list(keys), stored), table, values)


def new_classes(names: DataFrame, classes: DataFrame, model_id: int) -> DataFrame:
    """Classes to insert for the names of a batch.

    Book classes hang below the class ``其他``, which the catalog always has;
    series classes have no parent.
    """
    of_model = classes if model_id == fixed.BOOK_MODEL_ID else classes.where(F.col("model_id") == model_id)
    fresh = new_rows(names.select("class_name").where("class_name is not null"), of_model, ["class_name"],
                     ["class_name"])
    if model_id == fixed.BOOK_MODEL_ID:
        other = classes.where(F.col("class_name") == fixed.DEFAULT_CLASS)
        parent = other.agg(F.coalesce(F.min("id"), F.lit(0)).alias("id")).scalar()
    else:
        parent = F.lit(0)
    numbered = assign_ids(fresh, ["class_name"], classes)
    return with_defaults(numbered, "class", {"parent_id": parent, "model_id": model_id})


def attach_class(rows: DataFrame, classes: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    ids = classes.groupBy("class_name").agg(F.min("id").alias("class_id"))
    return lookup_join(rows, ids, ["class_name"], "left", spread_by)


def last_children(children: DataFrame, parent: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """The last child of every parent, as ``values``; map-side combined."""
    last = F.max_by(F.struct(*[v.alias(n) for n, v in values.items()]), F.struct(*order))
    return children.groupBy(parent).agg(last.alias("_last")).select(parent, "_last.*")


def first_items(items: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first item of every group."""
    return first_per_key(items, group, order)


def route_by_kind(episodes: DataFrame) -> dict[str, DataFrame]:
    """The two legs of the episode table; as a write it is ``partitionBy("kind")``."""
    return {kind: episodes.where(F.col("kind") == kind) for kind in (fixed.BAIDU, fixed.QVOD)}


def refetch_covers(matched: DataFrame, stored: DataFrame) -> DataFrame:
    """Cover requests for stored rows that have none.

    ``matched`` (id, image_url), ``stored`` (id, face_image).
    """
    lacking = stored.where("coalesce(face_image, '') = ''").select("id")
    asked = matched.where("image_url <> ''").groupBy("id").agg(F.min("image_url").alias("image_url"))
    return cover_worklist(asked.join(lacking, "id"))


def cover_worklist(rows: DataFrame) -> DataFrame:
    """(id, image_url, path) of the covers to fetch."""
    return rows.where("image_url <> ''").select(
        "id", "image_url", F.format_string(fixed.COVER_PATH, "id").alias("path"))
