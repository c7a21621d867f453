"""Fill-in-middle transformation with content-defined chunk memoization.

A text is cut into lines; prefix, middle and suffix end after numbers of lines that follow from a hash of the document's id.  To count the
lines and to find the places of the cuts, a text is split into chunks where a rolling hash of the last ``WINDOW`` bytes has ``MASK_BITS``
zeros, so that passages which documents share fall into the same chunks wherever they stand.  Of each chunk the task keeps a summary: where
its lines end, in bytes and in code points, and its code points in all.  A chunk met again is found by its hash, verified by its content, and
not looked at any further.  A text's number of lines is the sum over its chunks; a cut falls into the chunk that the running sum of lines
points to, at a place its summary holds.

The summaries live as long as their task and hold ``CACHE_BYTES`` of chunks at most, the oldest go first: that costs time, never a result.  Nothing
is shuffled, so no source or group of copies weighs on one task, and a lost task is simply done again.

Special cases.  A null text counts as empty.  An empty text, and one that contains a marker, stays plain.  A null doc_id has no digits in its hash.  Rows with
equal doc_id and text get equal results, each its own.  An empty table gives an empty result.  The other columns are carried along
in a struct, whatever their names.  A very long text is hashed in blocks of ``BLOCK`` bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import as_bytes, longs, sliced

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Percent of the texts that are cut, and of those that are written suffix first.
CUT_PERCENT = 100
SPM_PERCENT = 50
#: Bytes that the rolling hash sees, zeros that end a chunk (chunks of 2 KB on average), and the longest chunk.
WINDOW = 32
MASK_BITS = 11
LONGEST = 1 << 15
BLOCK = 1 << 18
CACHE_BYTES = 16 << 20

MADE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
#: A number for each byte, from a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
END, ALL = np.uint8(10), np.uint32((1 << MASK_BITS) - 1 << 32 - MASK_BITS)


def chunk_ends(data: bytes) -> np.ndarray:
    """Places in ``data`` after which the rolling hash ends a chunk, from the ``WINDOW``-th byte on."""
    found = []
    for start in range(0, len(data), BLOCK):
        lead = max(0, start - WINDOW + 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(len(data), start + BLOCK) - lead, lead)]
        reach = 1
        while reach < WINDOW:  # the hash over twice as many bytes
            longer = h.copy()
            longer[reach:] += h[:-reach] << np.uint32(reach)
            h, reach = longer, 2 * reach
        ends = np.flatnonzero((h & ALL) == 0) + lead + 1
        found.append(ends[(ends > start) & (ends >= WINDOW)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Chunk:
    """Summary of a chunk: ends of its lines in bytes and in code points, and its code points."""

    __slots__ = ("content", "ends", "chars_at", "chars")

    def __init__(self, content: bytes) -> None:
        self.content = content
        raw = np.frombuffer(content, np.uint8)
        ends = np.flatnonzero(raw == END) + 1
        firsts = (raw & 0xC0) != 0x80  # bytes that begin a code point
        if firsts.all():
            self.chars, at = len(content), ends
        else:
            so_far = np.cumsum(firsts)
            self.chars, at = int(so_far[-1]), so_far[ends - 1]
        self.ends, self.chars_at = ends.astype(np.uint32), at.astype(np.uint32)


class Memory:
    """Summaries of the chunks a task met, by hash, verified by content."""

    def __init__(self, most: int = CACHE_BYTES) -> None:
        self.most, self.held, self.known = most, 0, {}
        self.found = self.made = 0

    def chunk(self, content: bytes) -> Chunk:
        key = xxhash.xxh3_64_intdigest(content)
        one = self.known.get(key)
        if one is not None and one.content == content:
            self.found += 1
            return one
        self.made += 1
        new = Chunk(content)
        if one is None:
            self.known[key] = new
            self.held += len(content)
            while self.held > self.most:
                self.held -= len(self.known.pop(next(iter(self.known))).content)
        return new


class Lines:
    """A text's lines, from the summaries of its chunks."""

    def __init__(self, text: bytes, ends: list[int], memory: Memory) -> None:
        self.text, places, last = text, [0], 0
        for end in [*ends, len(text)]:
            while end - last > LONGEST:
                last += LONGEST
                places.append(last)
            if end > last:
                places.append(end)
                last = end
        self.places = places
        self.chunks = [memory.chunk(text[a:b]) for a, b in zip(places, places[1:])]
        self.upto = list(accumulate(len(c.ends) for c in self.chunks))
        self.chars = [0, *accumulate(c.chars for c in self.chunks)]
        self.n = (self.upto[-1] if self.upto else 0) + (not text.endswith(b"\n") if text else 0)

    def after(self, k: int) -> tuple[int, int]:
        """Where the first ``k`` lines end: bytes, code points."""
        if k == 0 or k >= self.n:
            return (0, 0) if k == 0 else (len(self.text), self.chars[-1])
        c = bisect_left(self.upto, k)
        i = k - 1 - (self.upto[c - 1] if c else 0)
        return self.places[c] + int(self.chunks[c].ends[i]), self.chars[c] + int(self.chunks[c].chars_at[i])


def numbers(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: bytes, lines: Lines, hashes: list[int], cut_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)"""
    h1, h2, h3, h4 = hashes
    n = lines.n
    if not text or h3 % 100 >= cut_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    (a, chars_a), (b, chars_b) = (lines.after(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    head, tail = (PREFIX, text[:a]), (SUFFIX, text[b:])
    form, order = ("spm", (*tail, *head)) if h4 % 100 < spm_percent else ("psm", (*head, *tail))
    return n, form, chars_a, chars_b - chars_a, b"".join((*order, MIDDLE, text[a:b]))


def transform(docs: DataFrame, keep: list[str] | None = None, seed: int = SEED, cut_percent: int = CUT_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Struct columns ``row`` (the kept columns, all by default) and ``made`` (n, form, prefix_chars, middle_chars, output)."""
    keep = docs.columns if keep is None else keep
    packed = docs.select((F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))).alias("row"),
                         F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            for first, end in sliced(batch, batch.column(1)):
                part = batch.slice(first, end - first)
                texts = as_bytes(part.column(1))
                starts = [0, *accumulate(map(len, texts))]
                ends = chunk_ends(b"".join(texts))
                bounds = np.searchsorted(ends, starts).tolist()
                rows = []
                for i, (text, doc_id) in enumerate(zip(texts, part.column(2).to_pylist())):
                    own = ends[bounds[i]:bounds[i + 1]] - starts[i]
                    # Before its WINDOW-th byte the hash still sees the text before.
                    own = own[(own >= WINDOW) & (own < len(text))].tolist()
                    rows.append(transformed(text, Lines(text, own, memory), numbers(seed, doc_id), cut_percent, spm_percent))
                n, form, prefix, middle, output = map(list, zip(*rows))
                made = pa.StructArray.from_arrays(
                    [longs(n), pa.array(form, pa.string()), longs(prefix), longs(middle), pa.array(output, pa.binary()).cast(pa.string())],
                    MADE.names)
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["row", "made"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("made", MADE)]))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    parts = F.split(output, "<[PSM]>", -1)
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = F.when(form == "plain", output)
    for name, places in at.items():
        whole = whole.when(form == name, F.concat(*[F.get(parts, i) for i in places]))
    return whole


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    output = F.col("made.output")
    return transform(docs, ["doc_id"]).select(
        "row.doc_id", "made.n", "made.form", "made.prefix_chars", "made.middle_chars", F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, F.col("made.form")), 256).alias("restored_sha256"))


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """The documents, in their columns, with the outputs as texts."""
    done = transform(docs, **options)
    return done.select(*[(F.col("made.output") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
e AS (
  SELECT *, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, CAST(n AS BIGINT) AS n, form, array_to_string(l[1:least(a, b)], '') AS p,
         array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS s
  FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
