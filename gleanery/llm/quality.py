"""Quality rules: fixed base rules, and fences learnt from quantile sketches.

Four measures of a text (marks per word, repeated lines, repeated words, word length) are
whole numbers.  A sketch of a measure is a histogram whose buckets grow with the value
(32 to each doubling, so that a bucket's lower end is within 1/32 of its values): counting
rows per bucket builds it, adding counts merges it, the order of rows doesn't matter.  There is a sketch per
measure, language and source; those of a language are merged from them.
A document is held against the fences of its language and source.  The quartiles behind them are those of the
language and source blended with those of the language, by weight of count: the language counts as ``WEIGHT`` documents, however many it
has.  No language is judged by another.  A fence stands outside the middle half of the values by ``REACH``
times its width and by a margin.  The margin of word length, the measure that differs by language, is wider the fewer documents a language
has, by degrees: ``SPARE`` of them double it.

Special cases.  A null or empty text has no words and fails the base rules.  Null languages
and sources are groups of their own.  Every row is judged by itself; repeated rows count
as often as they are there.  An empty table gives an empty result.  Further columns of the documents are
carried along by ``judge`` in a struct, so names cannot clash.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import WHITE, longs, with_made
from gleanery.operators.skew import lookup_join
from gleanery.session import write_out

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
#: Percent of the words that may lie in repeated windows.
MAX_REPEATED = 20
WINDOW = 5
#: Documents of a language and source whose quartiles count as much as those of the language.
WEIGHT = 300
#: Documents of a language whose margin of word length is twice that of a language with any number of them.
SPARE = 100
REACH = 3
#: Least distance between the middle half and a fence, and whether the lower side has a fence.  Rates are per
#: thousand words or lines, word length is in hundredths of a character.
MEASURES = {"marks": (200, False), "lines": (300, False), "repeats": (100, False), "length": (150, True)}
#: Buckets of a sketch to each doubling of the value: 2 ** BITS.
BITS = 5

METRICS = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines")])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    codes = np.zeros(n, np.uint64)
    for i in range(window):
        codes = (codes ^ ids[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(32)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    change[:n][at] += 1
    change[window:window + n][at] -= 1
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def measure(_: list, texts: list[bytes | None]) -> dict[str, pa.Array]:
    out: dict[str, list[int]] = {n: [] for n in METRICS.names}
    known: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
    for text in texts:
        text = text or b""
        words = text.split()
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
        bare = text.translate(None, WHITE)
        out["n_words"].append(len(words))
        out["word_chars"].append(len(bare) if bare.isascii() else len(bare.decode()))
        out["n_symbols"].append(len(bare) - len(bare.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated_words(ids))
        out["n_text_lines"].append(len(lines))
    return {n: longs(v) for n, v in out.items()}


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * words)


def measures() -> list[tuple[str, Column]]:
    """The measures by name; null where a text has no words."""
    def rate(times: int, part: str, whole: str) -> Column:
        return F.expr(f"IF({whole} > 0, {times} * {part} DIV {whole}, NULL)")

    return [("marks", rate(1000, "n_symbols", "n_words")), ("lines", rate(1000, "n_dup_lines", "n_text_lines")),
            ("repeats", rate(1000, "n_repeat_words", "n_words")), ("length", rate(100, "word_chars", "n_words"))]


def bucket(value: Column) -> Column:
    """Lower end of the bucket that holds a whole number from 0 on."""
    shift = F.greatest(F.length(F.bin(value)) - (BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(metrics: DataFrame) -> DataFrame:
    """Cells of the sketches: _lang, _source, measure, bucket, docs."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(c).alias("bucket")) for n, c in measures()]))
    return (metrics.where(~base_failed()).select("_lang", "_source", cells.alias("c"))
            .groupBy("_lang", "_source", "c.measure", "c.bucket").agg(F.count("*").alias("docs")))


def merge(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys, "measure", "bucket").agg(F.sum("docs").alias("docs"))


def quartiles(cells: DataFrame, *keys: str) -> DataFrame:
    """The keys and a map from measure to lower and upper quartile and number of documents.

    The windows run over the buckets of one sketch, of which there are some hundred at most.
    """
    by = Window.partitionBy(*keys, "measure")
    so_far = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.sum("docs").over(so_far)).withColumn("all", F.sum("docs").over(by))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
    found = run.groupBy(*keys, "measure").agg(F.struct(
        quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("all").alias("n")).alias("found"))
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("measure", "found"))).alias("quartiles"))


def fences(name: str, weight: int) -> Column:
    """Low and high fence of a measure from the quartiles ``own`` of a language and source and ``lang`` of the language."""
    blend = lambda q: F.expr(
        f"(own.{name}.n * own.{name}.{q} + {weight} * lang.{name}.{q}) DIV (own.{name}.n + {weight})")
    margin, below = MEASURES[name]
    spare = F.expr(f"{margin * SPARE} DIV lang.{name}.n") if name == "length" else F.lit(0)
    width = REACH * (blend("q3") - blend("q1")) + margin + spare
    return F.struct((blend("q1") - width if below else F.lit(None).cast("long")).alias("low"), (blend("q3") + width).alias("high"))


def judge(docs: DataFrame, keep: list[str] | None = None, weight: int = WEIGHT) -> DataFrame:
    """Struct column ``row`` (the kept columns, all by default), the measures, base_failed and kept."""
    keep = docs.columns if keep is None else keep
    label = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    made = with_made(docs, [F.struct(*keep).alias("row"), label("lang").alias("_lang"), label("source").alias("_source")],
                     "text", METRICS, measure)
    metrics = write_out(made.select("row.*", "made.*"), "metrics")
    cells = write_out(sketches(metrics), "sketch")
    by_lang = merge(cells, "_lang")
    groups = (quartiles(cells, "_lang", "_source").withColumnRenamed("quartiles", "own")
              .join(quartiles(by_lang, "_lang").withColumnRenamed("quartiles", "lang"), "_lang"))
    ends = F.struct(*[fences(name, weight).alias(name) for name in MEASURES]).alias("_fences")
    chosen = write_out(groups.select("_lang", "_source", ends), "fences")
    held = lookup_join(metrics, chosen, ["_lang", "_source"], "left", ["n_words", "word_chars"])
    within = F.lit(True)
    for name, value in measures():
        ends = F.col("_fences")[name]
        within = within & F.coalesce(value <= ends["high"], F.lit(True)) & F.coalesce(value >= ends["low"], F.lit(True))
    return held.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)


def report(docs: DataFrame) -> DataFrame:
    return judge(docs, ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, in their columns, that pass all rules."""
    return judge(docs).where("kept").select("row.*")
