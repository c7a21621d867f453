"""Session helpers: settings, the shared folder and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Accept every charset of the JVM in decode(), legacy ones included.
    "spark.sql.legacy.javaCharsets": "true",
    # A malformed byte becomes a replacement character.
    "spark.sql.legacy.codingErrorAction": "true",
    # A pass has the plans of the pass before: their code is compiled once.
    "spark.sql.codegen.cache.maxEntries": "3000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_local_dirs: dict[str, str] = {}
_made: list[str] = []


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: what ``spark.checkpoint.dir`` names.

    Only a local session may go without; it gets a folder of its own, which
    is removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder; all folders of an application lie below one of its own."""
    _made.append(f"{shared_dir(spark)}/gleanery/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def folders() -> Iterator[list[str]]:
    """The folders that ``new_path`` hands out meanwhile, known when the block ends."""
    start, made = len(_made), []
    try:
        yield made
    finally:
        made += _made[start:]


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        store, at = _hadoop(spark, path)
        store.delete(at, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that is not there yet; False if it is, whoever was first.

    Stores like HDFS create a file exclusively.  Hadoop's local file system looks first and creates then, so
    there a written file is linked to its name, which fails if the name is taken.
    """
    store, at = _hadoop(spark, path)
    if store.getScheme() == "file":
        name = at.toUri().getPath()
        folder, _, last = name.rpartition("/")
        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/.{last}.{uuid.uuid4().hex}"
        with open(own, "x", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(own, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    try:
        out = store.create(at, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    store, at = _hadoop(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def read_small(spark: SparkSession, path: str) -> str | None:
    """Text of a small file, None if there is none."""
    store, at = _hadoop(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Rows of the tables that were written, and the bytes of their texts and numbers, where these are their only columns.
_sizes: dict[str, tuple[int, int | None]] = {}
FLAT = ("string", "binary", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _write(df: DataFrame, label: str, partition_by: list[str] | None = None) -> tuple[DataFrame, int]:
    path, seen = new_path(df.sparkSession, label), Observation()
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema]
    texts = [F.octet_length(F.col(f"`{name}`")) for name, kind in kinds if kind in ("string", "binary")]
    length = F.lit(0).cast("bigint")
    for t in texts:
        length = length + F.coalesce(t, F.lit(0))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).write.parquet(
        path, partitionBy=partition_by)
    rows = seen.get["rows"]
    flat = all(kind in FLAT for _, kind in kinds)
    _sizes[_below(path)] = rows, seen.get["bytes"] + 16 * len(kinds) * rows if flat else None
    return df.sparkSession.read.schema(df.schema).parquet(path), rows


def _below(path: str) -> str:
    """The part of a path that is the same however a store writes it."""
    return path[path.find("/gleanery/"):]


def size_of(path: str) -> tuple[int, int | None] | None:
    """Rows and bytes of a table that was written, if it is known here."""
    return _sizes.get(_below(path))


def write_out(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The table cuts the lineage, survives the loss of executors, is read column
    by column, and has a known size from which Spark can plan the next join.
    """
    return _write(df, label, partition_by)[0]


def write_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``write_out``, dealt out by a column: a join on it moves the other side only."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    name = "gleanery_" + path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))
    return spark.table(name)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``write_out`` with the number of rows, which the write itself counts."""
    return _write(df, label)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores.

    Text work is heavy per row, and a small file is a single split.  An input
    of many splits is left as it is.  Meant for tables as they are read: counting
    the partitions of a query with a shuffle would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
