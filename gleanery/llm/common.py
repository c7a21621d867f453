"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gleanery.session import counted

#: The white space of the word rules: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(UPPER, UPPER.lower())
#: Lower-cases A-Z and turns every other ASCII character but letters and digits into a blank.
ALNUM = bytes(
    LOWER[b] if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)
)
#: Bytes of text that a task holds as Python objects at a time.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that goes to Python where its rows are sets or whole texts.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
#: Rows of a fixed width of at most 32 bytes that may be broadcast (16 MB).
SMALL_ROWS = 500_000


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def sliced(batch: pa.RecordBatch, text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with at most ``limit`` bytes of text, one row at least."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(text).to_pylist()):
        if size and size + (n or 0) > limit:
            yield start, i
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield start, batch.num_rows


def with_made(
    docs: DataFrame, keep: Sequence[str | Column], text: str | Column, made: T.StructType,
    make: Callable[[list, list[bytes | None]], dict[str, pa.Array]], given: str | Column | None = None,
) -> DataFrame:
    """Rows of the struct columns ``row`` (the columns ``keep``, untouched) and ``made``.

    ``make`` gets the column ``given`` (Nones without one) and the UTF-8 texts of
    some rows and returns an array for each field of ``made``.  The kept columns lie in
    a struct, so that no name of theirs can clash with a made one.
    """
    packed = docs.select(
        (F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))).alias("row"),
        (F.col(text) if isinstance(text, str) else text).alias("text"),
        (F.lit(None).cast("long") if given is None else F.col(given) if isinstance(given, str) else given).alias("given"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in sliced(batch, batch.column(1)):
                part = batch.slice(start, end - start)
                out = make(part.column(2).to_pylist(), as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.StructArray.from_arrays([out[n] for n in made.names], made.names)],
                    ["row", "made"])

    return packed.mapInArrow(run, T.StructType([
        packed.schema["row"], T.StructField("made", made)]))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, what is written goes to Python in batches of BATCH_BYTES."""
    usual = spark.conf.get(BATCH_BYTES[0])
    spark.conf.set(*BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES[0], usual)


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def spread_fetch(left: DataFrame, key: str, other: str, right: DataFrame, salts: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` on ``key``, with hot keys of ``left`` split.

    A left row's share is a hash of its column ``other``.  Of each right row there is
    one copy per share that some left row of its key really falls into, so that a key
    with many rows is spread over ``salts`` tasks and a key with one row costs one copy.
    ``right`` must hold few rows per key.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    copies = right.join(salted.select(key, "_salt").distinct(), key)
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``ids``, a column of unique longs.

    The ids are written out and counted; up to SMALL_ROWS of them are broadcast, more
    are joined by a shuffle.
    """
    ids, rows = counted(ids.select(key), label)
    return df.join(F.broadcast(ids) if rows <= SMALL_ROWS else ids.hint("merge"), key, "left_semi")
