"""Token ids in binary files, with Elias-Fano coded document boundaries.

Documents are dealt out by ranges of doc_id; each task encodes its texts in order and writes
files of bounded size.  A manifest table, written by Spark, lists the files that count: it is the commit, so
that files of lost or repeated tasks are never read.  Reading adds up the manifest's token counts and takes each
file by itself.

File format, little-endian: magic ``GTK1``; bytes per id (1 byte: 2 or 4), 3 bytes of zero; 64-bit numbers of documents,
of documents without doc_id (they come first), of tokens, and the first doc_id; Elias-Fano list of the doc_ids, less
the first one; Elias-Fano list of the documents' ends, in tokens; the ids.

An Elias-Fano list holds n rising numbers up to u in about n * (2 + log2(u / n)) bits: the low bits of each, packed, and the high
bits in unary, as ones in a bit array; the position of every ``SAMPLE``-th one is noted, from which a lookup starts to count.  Reading selects the
boundaries of some documents at a time; a file's whole list is never decoded.

Special cases.  A null or empty text is just its end id.  Rows with equal doc_id are all written, ordered by their
text; null doc_ids come first.  An empty table makes no file and reads as no rows.  Other columns are not used.
"""

from __future__ import annotations

import json
import os
import string
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import sliced, small_batches

MAGIC = b"GTK1"
END = 0
#: Tokens of a file, about; a single longer document has a file of its own size.
FILE_TOKENS = 4_000_000
SAMPLE = 256
#: Documents whose boundaries are decoded at a time.
SLICE_DOCS = 2000
#: Rows of an Arrow batch and bytes of text that a task holds at a time.
BATCH_ROWS = "4000"
TEXT_BYTES = 4 << 20
#: Words whose ids a task remembers twice over: those met since it last began anew, and those met before that.
CACHE_WORDS = 200_000


class EliasFano:
    """Rising whole numbers from 0 on, coded."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.high)], "<u8").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The list that begins at ``at``, and where it ends."""
        n, low_bits, high = (int(x) for x in np.frombuffer(data, "<u8", 3, at))
        at += 24
        sizes = (-(-n * low_bits // 8), high, 4 * -(-n // SAMPLE))
        parts = []
        for size, kind in zip(sizes, ("u1", "u1", "<u4")):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, low_bits, *parts), at

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            place = i * self.low_bits + b
            out |= ((self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def _one(self, i: int) -> int:
        """Place of a one, by select: from the sample before it, whole bytes of ones are counted off."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, ones = place >> 3, int(self.high[place >> 3]) >> (place & 7) << (place & 7)
        while ones.bit_count() <= left:
            left -= ones.bit_count()
            byte += 1
            ones = int(self.high[byte])
        for _ in range(left):
            ones &= ones - 1
        return 8 * byte + (ones & -ones).bit_length() - 1

    def run(self, first: int, last: int) -> np.ndarray:
        """The numbers from ``first`` up to ``last``: select finds the first, those after it follow in the bits."""
        last = min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        place, ones = self._one(first), [np.zeros(0, np.int64)]
        byte, left = place >> 3, last - first
        while left:
            step = 64 + left // 4
            found = np.flatnonzero(np.unpackbits(self.high[byte:byte + step], bitorder="little")) + 8 * byte
            found = found[found >= place][:left]
            ones.append(found)
            byte, left = byte + step, left - len(found)
        rank = np.arange(first, last)
        return (np.concatenate(ones) - rank << self.low_bits) | self._low(rank)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.run(i, i + 1)[0])


class Words(dict):
    """Ids of words, made when they are first asked for; what was not asked for in a whole round is forgotten."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids

    def forget(self, most: int) -> None:
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Encodes texts with a tokenizer, remembering the ids of words.

    A byte-level BPE parts white space from what is before it: of a run of it, the last character is apart, and
    goes with the word after it if it is a blank; a run at the end of a text is one piece.  So are ASCII letters and a mark
    after them.  Texts are cut there, many at a time, and the ids of the pieces, joined, are the ids of the text.  Each piece is asked for
    once for all these texts.  A new word goes through the tokenizer's model; one that is more than letters is split by
    the tokenizer's own first step before, or, if it is letters and a mark at their end, there.  Texts with white space other than
    blanks, tabs and ends of lines are encoded whole.

    The tokenizer and the words it has met stay in the worker, for the tasks that follow.
    """

    _last: tuple[str, tuple, Words] | None = None
    _other_white = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    #: Letters up to here are letters in every version of Unicode.
    _plain = "\u0500"
    _marks = ".,;:!?"
    # By byte: white space, marks, letters.
    _is_white, _is_mark, _is_letter = (
        np.isin(np.arange(256), list(chars.encode())) for chars in (" \t\n\r", _marks, string.ascii_letters))

    def __init__(self, path: str) -> None:
        if Encoder._last is None or Encoder._last[0] != path:
            Encoder._last = path, self._opened(path), Words(self.word)
        self.tokenizer, self.joins, self.signs = Encoder._last[1]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.split, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.code = {2: "H", 4: "I"}[self.kind.itemsize]
        self.known = Encoder._last[2]  # with the blank before them

    @staticmethod
    def _opened(path: str) -> tuple:
        """The tokenizer, whether it may be fed piece by piece, the characters that stand for the bytes of a character."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark shares out the cores
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        parts = json.loads(tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        joins = (parts["normalizer"] is None and before.get("type") == "ByteLevel"
                 and not before.get("add_prefix_space") and before.get("use_regex", True))
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {c: plain.pre_tokenize_str(chr(c))[0][0] for c in range(ord(Encoder._plain))}
        return tokenizer, joins, signs

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def cut(self, texts: pa.StringArray) -> pa.ListArray:
        """The pieces of each text."""
        bounds = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, "<i4")
        data = np.frombuffer(texts.buffers()[2] or b"", "u1")[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        full = bounds[1:] > bounds[:-1]
        white = self._is_white[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[:-1] = white
        begins[1:-1] &= ~(white[:-1] & white[1:])  # the first of a run
        begins[1:-1] |= white[:-1] & ~white[1:] & (data[:-1] != ord(" "))
        begins[1:-1] |= self._is_letter[data[:-1]] & self._is_mark[data[1:]]
        last = white[:-1] & ~white[1:]
        last[bounds[1:][full][:-1] - 1] = False  # the run ends the text
        begins[:-2] |= last
        begins[bounds] = True
        at = np.flatnonzero(begins).astype("<i4")
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds), pa.int32()), pieces)

    def word(self, word: str) -> bytes:
        """Ids of a word that may have a blank before it."""
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha() and (bare.isascii() or max(bare) < self._plain):
            signs = word.replace(" ", self.signs[ord(" ")]) if bare.isascii() else word.translate(self.signs)
            return self._bytes([token.id for token in self.model.tokenize(signs)])
        if bare[-1:] in self._marks and bare[:-1].isalpha():
            return self.known[word[:-1]] + self.known[word[-1]]
        return self._bytes([token.id for piece, _ in self.split.pre_tokenize_str(word) for token in self.model.tokenize(piece)])

    def encode(self, texts: pa.StringArray | Sequence[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        self.known.forget(CACHE_WORDS)
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.joins:
            return [self.whole(text) for text in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, self._other_white)
        cut = self.cut(texts.filter(pc.invert(odd)))
        pieces = cut.values.dictionary_encode()
        ids = pa.array([self.known[piece] for piece in pieces.dictionary.to_numpy(zero_copy_only=False)], pa.binary()).take(pieces.indices)
        joined = iter(pc.binary_join(pa.ListArray.from_arrays(cut.offsets, ids), b"").to_pylist())
        return [self.whole(text.as_py()) if whole else next(joined) for text, whole in zip(texts, odd.to_pylist())]


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path in it of a folder that Spark names."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class File:
    """Documents of one file, in order."""

    def __init__(self, kind: np.dtype) -> None:
        self.kind, self.docs, self.ids, self.tokens = kind, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.ids += [ids, np.array([END], self.kind).tobytes()]
        self.tokens += len(ids) // self.kind.itemsize + 1

    def dump(self) -> list[bytes]:
        known = [d for d in self.docs if d is not None]
        ends = np.cumsum([(len(x) + len(e)) // self.kind.itemsize for x, e in zip(self.ids[::2], self.ids[1::2])])
        first = known[0] if known else 0
        head = MAGIC + bytes([self.kind.itemsize, 0, 0, 0]) + np.array(
            [len(self.docs), len(self.docs) - len(known), self.tokens, first], "<i8").tobytes()
        ids = np.array(known, np.int64).view(np.uint64) - np.array([first], np.int64).view(np.uint64)
        return [head, EliasFano.of(ids).dump(), EliasFano.of(ends).dump(), *self.ids]


def load(data: bytes) -> Loaded:
    if data[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, without, tokens, first = (int(x) for x in np.frombuffer(data, "<i8", 4, 8))
    known, at = EliasFano.load(memoryview(data), 40)
    ends, at = EliasFano.load(memoryview(data), at)
    return Loaded(without, first, known, ends, np.frombuffer(data, f"<u{data[4]}", tokens, at))


@dataclass(frozen=True)
class Loaded:
    """A file: documents without doc_id, the first doc_id, the others less that, ends, ids."""

    without: int
    first: int
    known: EliasFano
    ends: EliasFano
    ids: np.ndarray

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        none = max(0, min(last, self.without) - first)
        low = np.array([self.first], np.int64).view(np.uint64)
        own = self.known.run(max(0, first - self.without), max(0, last - self.without)).view(np.uint64) + low
        return [None] * none + own.view(np.int64).tolist()

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents begin, and where the last of them ends."""
        ends = self.ends.run(max(0, first - 1), last)
        return ends if first else np.concatenate([[0], ends])


MANIFEST = "part int, number int, file string, docs long, tokens long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, file_tokens: int = FILE_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) into files below ``path``, in the order of doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (texts.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, folder = filesystem(path)
        file = File(encoder.kind)

        def flush() -> pa.RecordBatch:
            nonlocal file, number
            name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.gtk"  # a repeated task writes files of its own
            with store.open_output_stream(f"{folder}/{name}") as out:
                for piece in file.dump():
                    out.write(piece)
            row = [part, number, name, len(file.docs), file.tokens]
            file, number = File(encoder.kind), number + 1
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              ["part", "number", "file", "docs", "tokens"])

        for batch in batches:
            for start, end in sliced(batch, batch.column(1), TEXT_BYTES):
                rows = batch.slice(start, end - start)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1))):
                    file.add(doc_id, ids)
                    if file.tokens >= file_tokens:
                        yield flush()
        if file.docs:
            yield flush()

    store, folder = filesystem(path)
    store.create_dir(folder, recursive=True)
    conf, rows = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(rows)
    conf.set(rows, BATCH_ROWS)
    try:
        with small_batches(docs.sparkSession):
            ordered.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    finally:
        conf.set(rows, usual)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it) and ids (32-bit little-endian) of each document."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # Files are added up by groups, groups by their sums: no task sees all files of a huge corpus.
    files = files.withColumn("block", F.floor(F.col("part") / 1000))
    order = ("part", "number")
    blocks = files.groupBy("block").agg(F.sum("tokens").alias("sum"))
    from pyspark.sql import Window

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(blocks, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{folder}/{name}") as stream:
                    file = load(stream.read())
                wide = pa.py_buffer(file.ids.astype("<u4"))
                for i in range(0, file.ends.n, SLICE_DOCS):
                    at = file.bounds(i, i + SLICE_DOCS)
                    cells = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype("<i8")), wide]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids(i, i + SLICE_DOCS), pa.int64()), pa.array(at[:-1] + base, pa.int64()), cells],
                        ["doc_id", "start", "ids"])

    return (placed.select("file", (F.col("start") + F.col("base")).alias("start"))
            .repartition(partitions_for(spark), "file").mapInArrow(run, "doc_id long, start long, ids binary"))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def report(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` to ``path`` and read per document: doc_id, start, n_tokens, ids_crc32."""
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
