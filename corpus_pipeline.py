"""From raw documents to token files: quality rules, near duplicates, benchmark passages, the mix of sources, token ids.

Each stage gets the documents that its predecessor kept, in the columns of ``documents``; the last one writes the token files and
returns what it reads back from them: doc_id, start, n_tokens, ids_crc32.  A document that the mix takes twice
is there twice from then on.

Special cases.  Documents with a null or empty text, or with fewer words than the base rules ask for, go in the first stage.  Of rows with equal
doc_id and equal words one stays in the second.  A null doc_id, language or source is a value like any other; documents with a null doc_id have no near duplicates.
An empty table gives an empty result.  Columns other than those of ``documents`` are carried along as far as the mix, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontaminate, jaccard, mixing, quality, tokens
from gleanery.llm.common import BATCH_BYTES
from gleanery.llm.queries import table, tokenizer_path
from gleanery.session import folders, new_path, remove, write_out


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []
#: Words of a matched span from which on it is cut out of a document that stays.
MAX_SPAN = 50


def stage(work: Stage) -> Stage:
    """Stage that first removes the intermediate tables of the one before, unless ``docs`` still reads them.

    The bound on batches stays set: the caller writes the result.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(*BATCH_BYTES)
        read = docs.inputFiles()
        remove(spark, [p for p in _left if not any(p.rpartition("/")[2] in f for f in read)])
        with folders() as made:
            result = work(spark, docs, sf_dir)
        _left[:] = made
        return result

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


@stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_length=MAX_SPAN)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.report(docs, new_path(spark, "tokens"), tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: SQL has no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = write_out(work(spark, docs, sf_dir), name)
    _left.clear()  # the last result is still to be read by the caller
    return docs
