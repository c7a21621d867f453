"""The jobs as endless polls of a page folder.

A micro-batch is a pass: its pages join the memory of the poll, and the pass looks at the books or series that they bear on, whatever
the order in which lists, info pages and chapters land.  A page that was missing is waited for: it wakes its book when it
lands, and until it has been missed three times each pass asks for it again.  What is in the catalog already is not inserted
again.  A pass takes its batch number from the catalog: a repeated try is one of the same batch, and other writers have
other numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleanery.plans.books import harvest_books
from gleanery.plans.memory import Memory
from gleanery.plans.series import harvest_series
from gleanery.session import folders, remove
from gleanery.sources.catalog import Catalog
from gleanery.streaming.poll import page_stream, poll, raw_stream

Harvest = Callable[..., None]


def _poll(harvest: Harvest, name: str, catalog: Catalog, rules: DataFrame, landing: str, checkpoint: str,
          every: str | None, files_per_batch: int | None, raw: bool, options: dict[str, Any]) -> StreamingQuery:
    spark, folder = catalog.spark, checkpoint.rstrip("/")

    def work(pages: DataFrame, batch: int) -> None:
        writer = f"{name}:{checkpoint}:{batch}"
        with folders() as made:
            harvest(catalog, rules, pages, catalog.claim(writer), writer=writer,
                    memory=Memory(spark, f"{folder}/memory", batch), **options)
        remove(spark, made)

    stream = raw_stream if raw else page_stream
    return poll(stream(spark, landing, files_per_batch=files_per_batch), work, f"{folder}/state", every)


def poll_books(catalog: Catalog, rules: DataFrame, landing: str, checkpoint: str, every: str | None = None,
               files_per_batch: int | None = None, raw: bool = False, **options: Any) -> StreamingQuery:
    """``raw``: the folder holds page files, named by their URL, to be decoded by the charset of the rule that reads them."""
    return _poll(harvest_books, "books", catalog, rules, landing, checkpoint, every, files_per_batch, raw, options)


def poll_series(catalog: Catalog, rules: DataFrame, landing: str, checkpoint: str, every: str | None = None,
                files_per_batch: int | None = None, raw: bool = False, **options: Any) -> StreamingQuery:
    return _poll(harvest_series, "series", catalog, rules, landing, checkpoint, every, files_per_batch, raw, options)
