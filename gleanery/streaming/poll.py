"""Continuous harvesting: a page folder is polled, every batch runs the batch code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.schemas import PAGE
from gleanery.sources import pages as page_source


def page_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_batch: int | None = None,
                schema: str = PAGE) -> DataFrame:
    """Pages as they land in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def raw_stream(spark: SparkSession, path: str, glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Page files as they land in a folder: page_id, url, content.

    A file's name is its URL, percent-encoded; of two files of one URL the later one has the higher page_id.
    """
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        F.unix_micros("modificationTime").alias("page_id"), page_source.url_of_file(F.col("path")).alias("url"), "content")


def poll(pages: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
         every: str | None = None) -> StreamingQuery:
    """Run ``work(pages, batch)`` on every batch, once for what is there or on
    and on ``every`` so often.

    ``work`` must replace what an earlier try of the same batch wrote; batches
    are numbered from 1 in a catalog, whose batch 0 is the seed.
    """
    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: work(df, batch + 1))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
