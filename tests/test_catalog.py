"""Claims and commits of writers that work at the same time."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from gleanery.session import create_once, names_in, read_small
from gleanery.sources.catalog import Catalog


def classes(spark, *names):
    return {"class": spark.createDataFrame([(5, n, 0, 4) for n in names], "id long, class_name string, parent_id long, model_id int")}


def names(catalog):
    return sorted(r["class_name"] for r in catalog.table("class").where("batch > 0").collect())


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "folder" / "one")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: create_once(spark, path, f"writer {i}"), range(8)))
    assert won.count(True) == 1 and read_small(spark, path) == f"writer {won.index(True)}"
    assert names_in(spark, str(tmp_path / "folder")) == ["one"]
    assert read_small(spark, str(tmp_path / "none")) is None and names_in(spark, str(tmp_path / "none")) == []


def test_writers_at_the_same_time_get_different_numbers(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path), ["class"])
    # Each has a view of its own, as processes have.
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: Catalog(spark, str(tmp_path)).claim(f"writer {i}"), range(6)))
    assert len(set(numbers)) == 6
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: Catalog(spark, str(tmp_path)).commit(numbers[i], classes(spark, f"c{i}"), f"writer {i}"), range(6)))
    assert names(catalog) == [f"c{i}" for i in range(6)]
    assert [Catalog(spark, str(tmp_path)).claim(f"writer {i}") for i in range(6)] == numbers


def test_tries_of_one_batch_count_once(spark, tmp_path):
    """Two tries of a batch, as after a lost driver: one counts, whole; the other leaves nothing."""
    catalog = Catalog.create(spark, str(tmp_path), ["class", "cover"])
    number = catalog.claim("poll 1")
    cover = {"cover": spark.createDataFrame([("book", 1, "u", "p")], "parent string, id long, image_url string, path string")}
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda n: Catalog(spark, str(tmp_path)).commit(number, classes(spark, n) | cover, "poll 1"), ("a", "b")))
    assert len(names(catalog)) == 1 and catalog.table("cover").count() == 1
    won = names(catalog)
    catalog.commit(number, classes(spark, "again"), "poll 1")  # a replay
    assert names(catalog) == won
    assert len(names_in(spark, f"{tmp_path}/class/batch={number}")) == 1


def test_a_try_that_was_not_committed_is_not_read(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path), ["class"])
    catalog.commit(1, classes(spark, "a"))
    classes(spark, "lost")["class"].write.parquet(f"{tmp_path}/class/batch=1/attempt=lost")
    classes(spark, "lost")["class"].write.parquet(f"{tmp_path}/class/batch=2/attempt=lost")
    assert names(catalog) == ["a"]
    assert [p.rpartition("/")[2] for p in catalog.remove_leftovers()] == ["attempt=lost"]
    assert names(catalog) == ["a"] and len(names_in(spark, f"{tmp_path}/class/batch=1")) == 1


def test_numbers_of_others_are_refused(spark, tmp_path):
    catalog = Catalog.create(spark, str(tmp_path), ["class"])
    number = catalog.claim("a")
    with pytest.raises(ValueError, match="claimed"):
        catalog.commit(number, classes(spark, "b"), "b")
    catalog.commit(9, classes(spark, "c"), "c")
    with pytest.raises(ValueError, match="committed"):
        catalog.commit(9, classes(spark, "d"), "d")
    assert names(catalog) == ["c"] and catalog.last_batch() == 9 and catalog.claim("e") == 10
