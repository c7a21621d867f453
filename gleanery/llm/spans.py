"""Substring dedup by sliding runs of sentences.

A run is a number of consecutive sentences with at least ``RUN_WORDS`` words, and at least ``RUN_SENTENCES`` sentences or
``LONG_WORDS`` words.  The shortest run that begins at each sentence and the shortest that ends there are hashed; within a longer
run that repeats, these cover every sentence, so that the result is that of all runs.  Equal runs meet in a global join; of each, the occurrence
in the least document, at the first place, is the first.  Sentences that any other occurrence covers are removed.

Runs are counted by their hash below the shuffle, so that a passage which a third of all documents share costs no task more than
another; only runs that occur twice go on to the join, where the rows of very frequent ones are dealt out by document.

Rules.  A sentence ends after a full stop, question mark, exclamation mark or ellipsis before white space, after the same marks of
Chinese and Japanese, and at a line end.  Sentences are equal if their words are, lower-cased, of ASCII
letters, digits and characters beyond ASCII; what has no words is no sentence.

Special cases.  A null or empty text has no sentences and stays as it is.  Rows with equal doc_id and text are one document: they are
cut alike, and not for each other's sake.  A null doc_id comes before all others.  An empty table gives an empty result.  A document all of whose
sentences repeat earlier ones becomes an empty text.  Columns other than doc_id and text are carried along by ``remove_repeats`` in a
struct, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import ALNUM, longs, with_made
from gleanery.session import counted, write_out

RUN_SENTENCES = 2
RUN_WORDS = 20
LONG_WORDS = 25
#: A run is dealt out by document from this share of all runs on.
HOT_SHARE = 1 / 2000
NO_ID = -(1 << 63)

END = re.compile("[.!?…。！？\n](?:(?<=[。！？\n])|\\s)\\s*")

RUNS = T.StructType([T.StructField("tie", T.IntegerType()), T.StructField("runs", T.ArrayType(T.StructType([
    T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType()), T.StructField("at", T.LongType())])))])


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, with the white space after them."""
    ends = [m.end() for m in END.finditer(text)]
    starts = [0, *ends]
    return [(a, b) for a, b in zip(starts, [*ends, len(text)]) if text[a:b].encode().translate(ALNUM).strip()]


def keys_of(text: str) -> list[list[bytes]]:
    """The words of each sentence."""
    return [w for part in END.split(text) if (w := part.encode().translate(ALNUM).split())]


def shortest(sizes: list[int], run_sentences: int, run_words: int, long_words: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest run that begins at each sentence, of sizes in words, where enough come after it."""
    out, end, words = [], 0, 0
    for start in range(len(sizes)):
        if end < start:
            end, words = start, 0
        while end < len(sizes) and (
                words < run_words or end - start < run_sentences and words < long_words):
            words += sizes[end]
            end += 1
        if words >= run_words and (end - start >= run_sentences or words >= long_words):
            out.append((start, end))
        if end > start:
            words -= sizes[start]
    return out


def runs_of(sentences: list[list[bytes]], run_sentences: int, run_words: int, long_words: int) -> list[tuple[int, int]]:
    """(first, number) of the shortest runs that begin, and of those that end, at each sentence; each run once."""
    sizes = [len(w) for w in sentences]
    limits = run_sentences, run_words, long_words
    n = len(sizes)
    ending = [(n - end, n - start) for start, end in shortest(sizes[::-1], *limits)]
    return [(start, end - start) for start, end in sorted({*shortest(sizes, *limits), *ending})]


def tie_of(text: bytes | None) -> int:
    return int(np.int32(np.uint32(xxhash.xxh3_64_intdigest(text or b"") & 0xFFFFFFFF)))


def span_rows(docs: DataFrame, run_sentences: int, run_words: int, long_words: int) -> DataFrame:
    """h, g (96 bits of the run's hash), doc_id, tie, at (first sentence * 256 + sentences) of each run."""
    def make(_, texts):
        sizes, digests, at = [0], [], []
        for text in texts:
            own = keys_of(text.decode()) if text else []
            joined = [b" ".join(w) for w in own]
            for first, n in runs_of(own, run_sentences, run_words, long_words):
                digests.append(xxhash.xxh3_128_digest(b"\n".join(joined[first:first + n])))
                at.append(first << 8 | n)
            sizes.append(len(at))
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        rows = pa.StructArray.from_arrays(
            [pa.array(halves[:, 0]), pa.array((halves[:, 1] >> 32).astype(np.int32)), pa.array(at, pa.int64())], ["h", "g", "at"])
        return {"tie": pa.array([tie_of(t) for t in texts], pa.int32()),
                "runs": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)}

    made = with_made(docs, [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")], "text", RUNS, make)
    return made.select("row.doc_id", "made.tie", F.explode("made.runs").alias("r")).select("r.h", "r.g", "doc_id", "tie", "r.at")


def repeats(docs: DataFrame, run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS,
            long_words: int = LONG_WORDS, hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, tie, spans (at), firsts (doc_ids of first occurrences) of documents with runs that are not the first."""
    if run_words >= 256:
        raise ValueError("a run may have 255 sentences")
    runs, rows = counted(span_rows(docs, run_sentences, run_words, long_words), "runs")
    place = F.struct("doc_id", "tie", "at")
    found = (runs.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
             .where("first != last"))
    # Runs of a share of all rows, so of bounded number, are dealt out.
    twice = write_out(found.select("h", "g", "n", "first"), "repeated")
    each = max(1, int(rows * hot_share))
    shares = F.least(F.ceil(F.col("n") / each), F.lit(4096)).cast("int")
    hot = twice.where(F.col("n") > each).select("h", "g", shares.alias("_shares"))
    salt = lambda of: F.coalesce(F.pmod(F.xxhash64(*of), F.col("_shares")), F.lit(0)).cast("int")
    left = runs.join(F.broadcast(hot), ["h", "g"], "left").withColumn("_salt", salt(["doc_id", "at"])).drop("_shares")
    right = twice.select("h", "g", "first", F.explode(
        F.sequence(F.lit(0), F.when(F.col("n") > each, shares).otherwise(1) - 1)).alias("_salt"))
    later = left.join(right, ["h", "g", "_salt"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "tie").agg(F.collect_set("at").alias("spans"), F.collect_set("first.doc_id").alias("firsts"))


CUT = T.StructType([T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()),
                    T.StructField("text", T.StringType())])


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, **limits) -> DataFrame:
    """Struct columns ``row`` (the kept columns, all by default) and ``cut`` (n_sentences, n_removed, text), and ``firsts``."""
    keep = docs.columns if keep is None else keep
    cuts = write_out(repeats(docs, **limits), "cuts")
    packed = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"),
                         F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"))
    tied = with_made(packed, ["row", "text", "doc_id"], "text", T.StructType([T.StructField("tie", T.IntegerType())]),
                     lambda _, texts: {"tie": pa.array([tie_of(t) for t in texts], pa.int32())})
    joined = tied.select("row.row", "row.text", "row.doc_id", "made.tie").join(cuts, ["doc_id", "tie"], "left")

    def make(spans, texts):
        out: dict[str, list] = {"n_sentences": [], "n_removed": [], "text": []}
        for own, raw in zip(spans, texts):
            text = raw.decode() if raw is not None else None
            at = places(text) if text else []
            gone = {i for a in own or () for i in range(a >> 8, (a >> 8) + (a & 255))}
            out["n_sentences"].append(len(at))
            out["n_removed"].append(len(gone))
            if gone:
                parts, last = [], 0
                for i in sorted(gone):
                    parts.append(text[last:at[i][0]])
                    last = at[i][1]
                text = "".join([*parts, text[last:]])
                text = text if text.strip() else ""
            out["text"].append(text)
        return {"n_sentences": longs(out["n_sentences"]), "n_removed": longs(out["n_removed"]), "text": pa.array(out["text"], pa.string())}

    firsts = F.sort_array(F.coalesce(F.transform("firsts", lambda d: F.when(d != NO_ID, d)), F.array().cast("array<long>")))
    made = with_made(joined, ["row", firsts.alias("firsts")], "text", CUT, make, "spans")
    return made.select("row.row", F.col("made").alias("cut"), "row.firsts")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences, n_removed, first_doc_ids, text (what remains)."""
    return remove_repeats(docs, ["doc_id"]).select(
        "row.doc_id", "cut.n_sentences", "cut.n_removed", F.col("firsts").alias("first_doc_ids"), "cut.text")


def dedup_spans(docs: DataFrame) -> DataFrame:
    """The documents, in their columns, without repeated sentences."""
    done = remove_repeats(docs)
    return done.select(*[(F.col("cut.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
