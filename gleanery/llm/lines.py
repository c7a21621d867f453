"""Line dedup: documents probe a sharded minimal perfect hash of frequent lines.

Every distinct line key is counted over documents by its 128-bit hash.  Those found in
enough documents are dealt into shards; a task per shard builds a minimal perfect hash,
which gives each hash a number from 0 to n - 1, and fills arrays in the order of these numbers: a fingerprint (64
bits of the hash which the numbering does not use), the number of documents, and the largest
doc_id.  Documents then probe the arrays, and no line is joined.  A probe by a line that is
not in the structure meets another fingerprint and is refused.

Rules.  A text is split at \\n; a null or empty text is one empty line.  A line's key is the
line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased.  Keys of at least
``MIN_CHARS`` code points that ``MIN_DOCS`` documents or more hold lose all their lines but those in the largest
doc_id that holds them.

Special cases.  Each row counts as a document; rows that share the largest doc_id all keep the
line.  A null doc_id is below all others; if only such rows hold a line, they keep it.
Columns other than doc_id and text are carried along by ``drop_lines`` in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import LOWER, WHITE, longs, with_made
from gleanery.session import counted, write_out

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines of a shard on average.
SHARD_LINES = 100_000
#: Lines whose arrays one pass over the documents holds, about 20 bytes each; more lines mean more passes.
PASS_LINES = 4_000_000
#: Bits of a level of the perfect hash, per line that is left at it.
GAMMA = 2
LEVELS = 40
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes | None:
    """The line's key, if it is long enough."""
    key = line.strip(WHITE)
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode()) < MIN_CHARS:
        return None
    return key.translate(LOWER)


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) halves of the keys' 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    x = values ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values, by levels of bit arrays.

    At each level the values that meet no other at their bit stay; the rest go on.  A value's number is
    the count of set bits before its own.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []  # set bits before each word, over all levels
        total, left = 0, values
        for level in range(LEVELS):
            if not len(left):
                break
            bits = -(-max(GAMMA * len(left), 64) // 64) * 64
            place = mixed(left, level) % np.uint64(bits)
            order = np.argsort(place, kind="stable")
            ranked = place[order]
            met = np.zeros(len(left), bool)
            met[1:] |= ranked[1:] == ranked[:-1]
            met[:-1] |= ranked[1:] == ranked[:-1]
            alone = ranked[~met]
            words = np.zeros(bits // 64, np.uint64)
            np.bitwise_or.at(words, (alone >> np.uint64(6)).astype(np.int64), np.uint64(1) << (alone & np.uint64(63)))
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append(words)
            self.before.append((total + np.concatenate([[0], np.cumsum(ones)[:-1]])).astype(np.uint32))
            total += int(ones.sum())
            left = left[order[met]]
        self.rest = np.sort(left)  # values that met at every level
        self.total = total

    def numbers(self, values: np.ndarray) -> np.ndarray:
        """Each value's number; some number, or -1, for a value that is not one of the set."""
        out = np.full(len(values), -1, np.int64)
        todo = np.arange(len(values))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            place = mixed(values[todo], level) % np.uint64(64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[here]] = before[word[here]].astype(np.int64) + below[here]
            todo = todo[~here]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, values[todo]), len(self.rest) - 1)
            same = self.rest[at] == values[todo]
            out[todo[same]] = self.total + at[same]
        return out


class Shard:
    """Perfect hash of some lines and the arrays that its numbers index."""

    def __init__(self, slot: np.ndarray, mark: np.ndarray, docs: np.ndarray, last: np.ndarray) -> None:
        # Equal first halves are told apart by the second: all but one go to a sorted rest.
        _, first = np.unique(slot, return_index=True)
        more = np.setdiff1d(np.arange(len(slot)), first)
        self.hash = PerfectHash(slot[first])
        order = np.empty(len(first), np.int64)
        order[self.hash.numbers(slot[first])] = first
        self.mark, self.last = mark[order], last[order]
        self.docs = np.minimum(docs[order], 255).astype(np.uint8)
        self.more = {(int(slot[i]), int(mark[i])): int(last[i]) for i in more}

    def dump(self) -> bytes:
        """Plain data, which any worker can load."""
        return pickle.dumps(self.__dict__ | {"hash": self.hash.__dict__})

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        made, inner = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        made.__dict__.update(pickle.loads(blob))
        inner.__dict__.update(made.hash)
        made.hash = inner
        return made

    def probe(self, slot: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, largest doc_id) per line."""
        number = self.hash.numbers(slot)
        found = number >= 0
        found[found] = self.mark[number[found]] == mark[found]
        last = np.full(len(slot), NO_ID, np.int64)
        last[found] = self.last[number[found]]
        if self.more:
            for i in np.flatnonzero(~found):
                hit = self.more.get((int(slot[i]), int(mark[i])))
                if hit is not None:
                    found[i], last[i] = True, hit
        return found, last


class Prober:
    """The shards of a pass, which a task loads when it begins and lets go of when it ends."""

    def __init__(self, shared: Broadcast) -> None:
        self.shared, self.shards = shared, None

    def items(self) -> Iterable[tuple[int, Shard]]:
        if self.shards is None:
            self.shards = [(n, Shard.load(b)) for n, b in self.shared.value]
        return self.shards


KEYS = T.StructType([T.StructField("keys", T.ArrayType(T.StructType([
    T.StructField("slot", T.LongType()), T.StructField("mark", T.LongType())])))])


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, slot, mark: halves of the hash of each distinct key of a document."""
    def make(_, texts):
        sizes, flat = [0], []
        for text in texts:
            own = {k for x in (text or b"").split(b"\n") if (k := line_key(x)) is not None}
            flat += own
            sizes.append(len(flat))
        both = hashes(flat).astype("<u8").view(np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["slot", "mark"])
        return {"keys": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)}

    made = with_made(docs, ["doc_id"], "text", KEYS, make)
    return made.select("row.doc_id", F.explode("made.keys").alias("k")).select("doc_id", "k.slot", "k.mark")


def frequent(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """slot, mark, docs, last of the keys that enough documents hold; counted below the shuffle first."""
    return (line_keys(docs).groupBy("slot", "mark")
            .agg(F.count("*").alias("docs"), F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("last"))
            .where(F.col("docs") >= min_docs))


def build(lines: DataFrame, rows: int, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """(shard, blob) rows, and how many shards there are."""
    shards = max(1, -(-rows // shard_lines))

    def make(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        cells = {n: group.column(n).to_numpy() for n in ("slot", "mark", "docs", "last")}
        shard = Shard(cells["slot"].view(np.uint64), cells["mark"].view(np.uint64), cells["docs"], cells["last"])
        return pa.table({"shard": longs([key[0].as_py()]), "blob": pa.array([shard.dump()], pa.binary())})

    dealt = lines.withColumn("shard", F.pmod("mark", F.lit(shards)))
    return write_out(dealt.groupBy("shard").applyInArrow(make, "shard long, blob binary"), "lines"), shards


DROPS = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("dropped", T.ArrayType(T.LongType())),
                      T.StructField("kept", T.StringType())])


def drop_lines(docs: DataFrame, keep: list[str] | None = None, min_docs: int = MIN_DOCS, shard_lines: int = SHARD_LINES,
               pass_lines: int = PASS_LINES, text: bool = True) -> DataFrame:
    """Struct columns ``row`` (the kept columns, all by default) and ``lines``.

    ``lines`` has n_lines (before dropping), dropped (line numbers), and kept (the other lines joined,
    or, if not ``text``, the SHA-256 of that).
    """
    spark, text_wanted = docs.sparkSession, text
    keep = docs.columns if keep is None else keep
    lines, rows = counted(frequent(docs, min_docs), "frequent")
    built, shards = build(lines, rows, shard_lines)
    now = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    per_pass = max(1, pass_lines // shard_lines)
    for i in range(0, shards, per_pass):
        blobs = [tuple(r) for r in built.where(F.col("shard").between(i, i + per_pass - 1)).collect()]
        shared, last = spark.sparkContext.broadcast(blobs), i + per_pass >= shards

        prober = Prober(shared)  # each task gets its own

        def make(given, texts, prober=prober, last=last):
            own, at, flat = [], [], []
            for d, text in enumerate(texts):
                cut = (text or b"").split(b"\n")
                own.append(cut)
                for n, x in enumerate(cut):
                    if (key := line_key(x)) is not None:
                        at.append((d, n))
                        flat.append(key)
            dropped = [set(g["dropped"] or ()) for g in given]
            if flat:
                both = hashes(flat)
                home = both[:, 1].astype("<u8").view(np.int64) % shards
                ids = np.array([NO_ID if g["id"] is None else g["id"] for g in given], np.int64)
                for number, shard in prober.items():
                    mine = np.flatnonzero(home == number)
                    found, largest = shard.probe(both[mine, 0], both[mine, 1])
                    for j in mine[found][ids[[at[m][0] for m in mine[found]]] != largest[found]]:
                        dropped[at[j][0]].add(at[j][1])
            kept = [t if t is None and text_wanted else b"\n".join(x for n, x in enumerate(c) if n not in gone)
                    for t, c, gone in zip(texts, own, dropped)] if last else [None] * len(texts)
            if last and not text_wanted:
                kept = [hashlib.sha256(x).hexdigest().encode() for x in kept]
            return {"n_lines": longs([len(c) for c in own]),
                    "dropped": pa.array([sorted(x) for x in dropped], pa.list_(pa.int64())),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string())}

        dropped = F.col("made.dropped") if i else F.lit(None).cast("array<long>")
        done = with_made(now, ["row"] if last else ["row", "id", "text"], "text", DROPS, make,
                         F.struct(F.col("id").cast("long").alias("id"), dropped.alias("dropped")))
        if not last:
            now = write_out(done, "probe").select("row.row", "row.id", "row.text", "made")
    return done.select(F.col("row.row").alias("row"), F.col("made").alias("lines"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_lines(docs, ["doc_id"], text=False).select(
        "row.doc_id", "lines.n_lines", F.size("lines.dropped").cast("long").alias("n_dropped"),
        F.col("lines.kept").alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, in their columns, without the dropped lines."""
    done = drop_lines(docs)
    return done.select(*[(F.col("lines.kept") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
