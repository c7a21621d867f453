"""N-gram Jaccard join by parity sketches.

A document's set of shingles is hashed into a bit sketch: each shingle flips one bit.  The Hamming distance of two sketches is at most the size of the
sets' symmetric difference.  Two sets of Jaccard similarity num/den or more differ, if the smaller one has n
shingles, in at most d = (den - num) * n / num of them.  Sketches are cut into parts, more than d of which a set fills; its pieces (band, part, bits of
the part) are those of its first d + 1 parts that are not empty, and pieces are joined.  No link is missed: at most d of the parts differ, so that
the set whose first d + 1 filled parts end first has one among them that the other set has too, and has among its own first d + 1.  The number of
parts goes by band of set sizes, and is such that sets fill enough of them; a set that can have a partner in the next lower band is cut that
band's way too.  A set that fills too few all the same, by a chance of its hashes, is held against all sets of its sizes.

A part has 2 ** 64 bits, nearly all of them zero.  What is joined is the exclusive or of a hash of its set bits' numbers, which is equal for equal
parts.  A second, short sketch of the whole set, as long in bits as the set has shingles, weeds out candidates by their Hamming distance before the sets themselves are
compared, exactly, by 64-bit hashes of the shingles.

Equal sets are one class first, so copies cost nothing further.  Classes that share a piece are not paired all with all: each is held against the
first of its piece, links make components, and only pieces that hold several components are looked at again: against other pivots
first, then every member outside the piece's largest component against the members of other components.  Pairs within a
component need no test.  Pieces are range-partitioned by (piece, class), so that a piece with very many members is dealt out.

Special cases.  A null or empty text, or one without words, has the empty set and links with nothing, not even its like.  A text of fewer words than a
shingle has its whole sequence as its one shingle.  Rows with a null doc_id link with nothing and have a null component.  doc_ids are
meant to be unique; a row that shares its doc_id may also be given the other row's links.  An empty table gives an empty result.  Further columns are carried along by
``keep_first`` in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import LOWER, SMALL_ROWS, WHITE, small_batches, longs, partitions, semi_by_id, spread_fetch, with_made
from gleanery.llm.components import components
from gleanery.session import counted, write_out

#: Shingles and similarity of the query, and those of the pipeline.
QUERY = {"width": 3, "num": 90, "den": 100}
PIPELINE = {"width": 5, "num": 80, "den": 100}
#: Sizes of a band lie within this factor.
BAND = 1.5
#: A set fills enough parts unless it has fewer than expected by so many standard deviations.
SURE = 6
#: Parts of small sets, at least, and the sizes that count as small.
FEW_PARTS, SMALL_SET = 256, 64
#: 64-bit words of the short sketch of a set, at least and at most; in between, as many bits as shingles or more.
LEAST_SKETCH, MOST_SKETCH = 16, 1 << 12
#: Rounds with other pivots before all remaining pairs are tested; they only save work.
PIVOTS = 1
#: Members of a piece that a task pairs with the members outside its largest component.
SHARE = 1000
#: Bytes of text whose words are hashed together.
BLOCK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(of: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(BLOCK - 1, of, np.uint64))])


#: A word's hash is a sum over its bytes, of a number for the byte times a power that goes by its place, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
SIGNS = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
POWERS, INVERSE = powers(BASE), powers(pow(BASE, -1, 1 << 64))
IS_WHITE = np.isin(np.arange(256), list(WHITE))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where it begins, 64-bit hash) of each word of a lower-cased text."""
    raw = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(IS_WHITE[raw], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out, first = np.zeros(len(starts), np.uint64), 0
    while first < len(starts):
        at = starts[first]
        last = int(np.searchsorted(ends, at + BLOCK, "right"))
        if last <= first:  # a word longer than a block
            out[first] = xxhash.xxh3_64_intdigest(text[at:ends[first]])
            first += 1
            continue
        own = SIGNS[raw[at:ends[last - 1]]] * POWERS[:ends[last - 1] - at]
        upto = np.concatenate([[np.uint64(0)], np.cumsum(own, dtype=np.uint64)])
        begin = starts[first:last] - at
        out[first:last] = (upto[ends[first:last] - at] - upto[begin]) * INVERSE[begin]
        first = last
    return starts, mixed(out)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    at, size = [], 0
    for text in texts:
        at.append(size)
        size += len(text or b"") + 1
    starts, hashed = word_hashes(b"\n".join(t or b"" for t in texts).translate(LOWER))
    cuts = np.searchsorted(starts, [*at, size]).tolist()
    return [shingle_set(hashed[a:b], width) for a, b in zip(cuts, cuts[1:])]


def shingle_set(hashed: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words."""
    if not len(hashed):
        return np.zeros(0, np.uint64)
    width = min(width, len(hashed))
    out = np.full(len(hashed) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[i:i + len(out)])
    return np.unique(out)


class Bands:
    """Sizes of sets by band, and the number of parts of a band's sketches."""

    def __init__(self, num: int, den: int, factor: float = BAND) -> None:
        self.num, self.den, self.factor = num, den, max(factor, den / num + 0.05)
        self.known: dict[int, int] = {}

    def differ(self, n: int) -> int:
        """Shingles by which a set of n and a larger one that links with it differ, at most."""
        return (self.den - self.num) * n // self.num

    def low(self, band: int) -> int:
        return math.ceil(self.factor ** band)

    def of(self, n: int) -> int:
        band = int(math.log(n) / math.log(self.factor))
        while self.low(band) > n:
            band -= 1
        while self.low(band + 1) <= n:
            band += 1
        return band

    def parts(self, band: int) -> int:
        """Parts, as few as the largest set that is cut this way may have."""
        if band not in self.known:
            n = (self.low(band + 1) - 1) * self.den // self.num
            parts = FEW_PARTS if n < SMALL_SET else self.differ(n) + 1
            while n >= SMALL_SET:
                empty = math.exp(-n / parts)
                spread = math.sqrt(parts * empty * max(0.0, 1 - (1 + n / parts) * empty))
                if parts * (1 - empty) - SURE * spread > self.differ(n) + 1:
                    break
                parts += 1 + parts // 64
            self.known[band] = parts
        return self.known[band]

    def ways(self, n: int) -> list[int]:
        """Bands whose way a set of n shingles is cut."""
        home = self.of(n)
        least = -(-n * self.num // self.den)  # the smallest partner
        return [b for b in range(self.of(max(1, least)), home + 1) if self.differ(self.low(b + 1) - 1)]


def pieces(own: np.ndarray, bands: Bands) -> tuple[list[np.ndarray], bool]:
    """Keys of a set's pieces, and whether it fills too few parts."""
    out, short = [], False
    need = bands.differ(len(own)) + 1
    if need == 1:
        return out, short
    place, bit = own >> np.uint64(32), mixed(own + np.uint64(0x2545F4914F6CDD1D))
    for band in bands.ways(len(own)):
        parts = bands.parts(band)
        content = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(content, (place % np.uint64(parts)).astype(np.int64), bit)  # a bit that is flipped twice is gone
        filled = np.flatnonzero(content)[:need]
        short |= len(filled) < need
        out.append(mixed(content[filled] ^ mixed(filled.astype(np.uint64) + np.uint64((band << 32) + 1))))
    return out, short


def short_sketch(own: np.ndarray) -> np.ndarray:
    """Words in which each shingle has flipped a bit; their number is a power of two."""
    size = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << max(0, (len(own) - 1) // 64).bit_length()))
    spot = mixed(own ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * size)
    out = np.zeros(size, np.uint64)
    np.bitwise_xor.at(out, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    return out


def apart(left: str, right: str) -> Column:
    """Hamming distance of two sketches, the longer one folded to the length of the other.

    Sets that may link differ in size by less than a factor of two, so that one fold suffices.
    """
    def fitted(own: str, other: str) -> str:
        half = f"CAST(size({own}) / 2 AS INT)"
        return (f"IF(size({own}) > size({other}), zip_with(slice({own}, 1, {half}), slice({own}, {half} + 1, {half}), (x, y) -> x ^ y), {own})")

    return F.expr(f"aggregate(zip_with({fitted(left, right)}, {fitted(right, left)}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")


SIGNED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("h", T.LongType()), T.StructField("g", T.LongType()),
    T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("short", T.BooleanType())])


def signatures(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """doc_id, n, h, g (128-bit hash of the set), sketch, keys (of the pieces), short (they may be too few)."""
    def make(_, texts):
        n, digests, sketches, sizes, keys, shorts = [], [], [], [0], [], []
        for own in shingle_sets(texts, width):
            n.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            sketches.append(short_sketch(own))
            own_keys, short = pieces(own, bands)
            keys += own_keys
            shorts.append(short)
            sizes.append(sizes[-1] + sum(map(len, own_keys)))
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return {
            "n": longs(n), "h": pa.array(halves[:, 0]), "g": pa.array(halves[:, 1]),
            "sketch": pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, sketches)]), pa.int32()), pa.array(np.concatenate(sketches).view(np.int64))),
            "keys": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64))),
            "short": pa.array(shorts, pa.bool_())}

    made = with_made(docs, ["doc_id"], "text", SIGNED, make)
    return made.select("row.doc_id", "made.*")


def meetings(classes: DataFrame) -> DataFrame:
    """key, node, pivot of the classes that share a piece with another; the pivot is the first of the piece.

    Rows sorted by (key, node) stream through; a run of equal keys is never held.  Where a run goes on in the next
    partition, its part there has a pivot of its own, and a few rows link the pivots.
    """
    rows = classes.select(F.explode("keys").alias("key"), "node")
    sorted_rows = rows.repartitionByRange(partitions(rows), "key", "node").sortWithinPartitions("key", "node")

    def rows_of(key, node, pivot, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [longs(key), longs(node), longs(pivot), pa.array([edge] * len(key), pa.bool_())], ["key", "node", "pivot", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_pivot = waiting = None  # waiting: the last row, so far alone in its run
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if last_key is None:
                yield rows_of(key[:1], node[:1], node[:1], True)
            new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            # The place of each row's first row in the batch, -1 where the run began before.
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            pivot = np.where(first >= 0, node[first], 0 if last_pivot is None else last_pivot)
            if waiting is not None and not new[0]:
                yield rows_of([last_key], [waiting], [last_pivot], False)
            out = ~new
            out[:-1] |= ~new[1:]
            waiting = None if out[-1] else node[-1]
            if out.any():
                yield rows_of(key[out], node[out], pivot[out], False)
            last_key, last_pivot = key[-1], pivot[-1]
        if last_key is not None:
            yield rows_of([last_key], [last_pivot], [last_pivot], True)

    met = write_out(sorted_rows.mapInArrow(run, "key long, node long, pivot long, edge boolean"), "meetings")
    # Pivots at the ends of partitions: those of one key are members of one piece.
    ends = met.where("edge").select("key", "node").distinct()
    shared = ends.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    return met.where("NOT edge").select("key", "node", "pivot").unionByName(ends.join(shared.drop("n"), "key").select("key", "node", "pivot"))


class Join:
    """The steps of one join; they share the classes and what has been tested."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int) -> None:
        self.docs, self.width, self.num, self.den = docs, width, num, den
        self.bands = Bands(num, den)
        self.salts = partitions(docs)
        self.signed = write_out(signatures(docs, width, self.bands), "signed")
        own = self.signed.where("n > 0 AND doc_id IS NOT NULL")
        # Classes of equal sets, by their least doc_id; that one's row has the sketch and the keys, which are not moved.
        self.classes = write_out(own.groupBy("h", "g", "n").agg(F.min("doc_id").alias("node"), F.first("short").alias("short")), "classes")
        self.own = own.select(F.col("doc_id").alias("node"), "n", "sketch", "keys")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link."""
        about = self.own.select("node", "n", "sketch")
        side = lambda x: about.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        near = spread_fetch(spread_fetch(pairs, "a", "b", side("a"), self.salts), "b", "a", side("b"), self.salts)
        small, large = F.least("na", "nb"), F.greatest("na", "nb")
        near = near.where(small * self.den >= large * self.num).where(
            apart("sa", "sb") * (self.den + self.num) <= (F.col("na") + F.col("nb")) * (self.den - self.num))
        near, rows = counted(near.select("a", "b").distinct(), "near")
        if not rows:
            return near
        nodes = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
        width, num, den = self.width, self.num, self.den
        texts = semi_by_id(self.docs.select("doc_id", "text"), nodes, "doc_id", "nodes")
        sets = write_out(with_made(
            texts, ["doc_id"], "text", T.StructType([T.StructField("set", T.BinaryType())]),
            lambda _, t: {"set": pa.array([x.tobytes() for x in shingle_sets(t, width)], pa.binary())}).select("row.doc_id", "made.set"), "sets")
        side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"s{x}"))
        if rows <= SMALL_ROWS:  # the pairs go to the sets; each set is moved once per pair
            both = side("a").join(F.broadcast(near), "a").join(side("b").join(F.broadcast(near), "b"), ["a", "b"])
        else:
            both = spread_fetch(spread_fetch(near, "a", "b", side("a"), self.salts), "b", "a", side("b"), self.salts)

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and den * shared >= num * (len(x) + len(y) - shared))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct()

    def more(self, labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components (node, component) when the links among ``pairs`` join those of ``labels``.

        Only components that a new link touches are walked; without one the labels stay as they are.
        """
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links, rows = counted(self.verify(ordered), "links")
        if not rows:
            return labels
        ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
        ends = write_out(ends.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "ends")
        side = lambda x: ends.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        between = spread_fetch(spread_fetch(links, "a", "b", side("a"), self.salts), "b", "a", side("b"), self.salts)
        merged = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b").distinct())
        known = labels.unionByName(ends.hint("merge").join(labels.select("node"), "node", "left_anti"))
        into = merged.select(F.col("node").alias("component"), F.col("component").alias("_into"))
        inside = spread_fetch(known, "component", "node", into, self.salts).select("node", F.col("_into").alias("component"))
        apart = known.join(into.hint("merge"), "component", "left_anti").select("node", "component")
        return write_out(inside.unionByName(apart), "labels")

    def join(self) -> DataFrame:
        """node, component of the classes that have a link; classes by their least doc_id."""
        met = write_out(meetings(semi_by_id(self.own.select("node", "keys"), self.classes.select("node").distinct(), "node", "nodes")), "met")
        # Each class against one pivot first; then against others, where these are not of its component by now.
        star = met.where("node != pivot")
        labels = components(self.verify(star.groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")))
        for_node = labels.withColumnRenamed("component", "_ln")
        for_pivot = labels.select(F.col("node").alias("pivot"), F.col("component").alias("_lp"))
        pairs = write_out(star.select("node", "pivot").distinct(), "pairs").join(for_node, "node", "left")
        apart = spread_fetch(pairs, "pivot", "node", for_pivot, self.salts).where("_ln IS NULL OR _ln != _lp").select("node", "pivot")
        alone = pairs.select("node", "pivot").join(labels.select(F.col("node").alias("pivot")).hint("merge"), "pivot", "left_anti")
        labels = self.more(labels, apart.unionByName(alone).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        crowded = met.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 2").select("key")
        members = write_out(met.join(crowded, "key", "left_semi"), "members")
        for turn in range(PIVOTS + 1):
            labelled = members.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn(
                "label", F.coalesce("label", "node"))
            mixed_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
            members, rows = counted(labelled.join(mixed_keys, "key", "left_semi").select("key", "node", "pivot", "label"), "open")
            if not rows:
                break
            if turn < PIVOTS:
                draw = F.struct(F.xxhash64("node", F.lit(turn)), "node", "label", "pivot")
                drawn = members.groupBy("key").agg(F.min(draw).alias("d")).select(
                    "key", F.col("d.node").alias("other"), F.col("d.label").alias("_label"), F.col("d.pivot").alias("_pivot"))
                pairs = members.join(drawn, "key").where("label != _label AND node != _pivot AND other != pivot")
            else:
                pairs = self.rest(members)
            labels = self.more(labels, pairs.select(F.col("node").alias("a"), F.col("other").alias("b")))
            members = members.select("key", "node", "pivot")
        few, rows = counted(self.classes.where("short").select(F.col("node").alias("b"), F.col("n").alias("m")), "short")
        if rows:
            sizes = (F.col("n") * self.den >= F.col("m") * self.num) & (F.col("m") * self.den >= F.col("n") * self.num)
            near = F.broadcast(few) if rows <= SMALL_ROWS else few
            pairs = self.classes.select(F.col("node").alias("a"), "n").join(near, sizes & (F.col("a") != F.col("b")))
            labels = self.more(labels, pairs.select("a", "b"))
        return labels

    def rest(self, members: DataFrame) -> DataFrame:
        """All pairs of members of a piece with different labels, but those of a member and its pivot, which are tested.

        One side is the members outside the piece's largest component.  Sketches are compared in the join.
        """
        sizes = members.groupBy("key", "label").agg(F.count("*").alias("rows"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("rows", "label"))["label"].alias("main"))
        info = self.own.select("node", "n", "sketch")
        full = write_out(members.join(info, "node").join(largest, "key"), "rest")
        few = full.where("label != main").select("key", F.col("node").alias("other"), F.col("label").alias("_label"),
                                                 F.col("pivot").alias("_pivot"), F.col("n").alias("_n"), F.col("sketch").alias("_sketch"))
        fits = (F.least("n", "_n") * self.den >= F.greatest("n", "_n") * self.num) & (
            apart("sketch", "_sketch") * (self.den + self.num) <= (F.col("n") + F.col("_n")) * (self.den - self.num))
        # A piece is dealt out by its number of members.
        shares = sizes.groupBy("key").agg(F.ceil(F.sum("rows") / SHARE).cast("int").alias("_shares"))
        salt = F.pmod(F.xxhash64("node"), F.col("_shares")).cast("int")
        spread = full.join(shares, "key").withColumn("_salt", salt).drop("_shares")
        copies = few.join(shares, "key").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
        left, right = spread.alias("l"), copies.alias("r")
        return left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l._salt") == F.col("r._salt"))
                         & (F.col("label") != F.col("_label")) & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("other")))
                         & (F.col("node") != F.col("_pivot")) & (F.col("other") != F.col("pivot")) & fits
                         ).select("node", "other")


def linked(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    with small_batches(docs.sparkSession):
        job = Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, num, den)
        labels = job.join()
    # A class has the component of its least doc_id; its rows have the class's, found by the hash of their set.
    own = job.classes.select("h", "g", "n", "node").join(labels, "node", "left").select(
        "h", "g", "n", F.coalesce("component", "node").alias("component"))
    rows = job.signed.select("doc_id", "n", "h", "g")
    found = spread_fetch(rows.where("n > 0 AND doc_id IS NOT NULL").withColumn("_key", F.struct("h", "g", "n")), "_key", "doc_id",
                         own.select(F.struct("h", "g", "n").alias("_key"), "component"), job.salts)
    alone = rows.where("n = 0 OR doc_id IS NULL")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(
        alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def report(docs: DataFrame) -> DataFrame:
    return linked(docs, **QUERY)


def keep_first(docs: DataFrame, width: int = PIPELINE["width"], num: int = PIPELINE["num"], den: int = PIPELINE["den"]) -> DataFrame:
    """The documents, in their columns, one of each component: the one with the least doc_id.

    Documents without words, and those with a null doc_id, stay.  Of rows that share the least doc_id of a component one stays.
    """
    links = write_out(linked(docs, width, num, den), "linked")
    gone = links.where("component_id != doc_id").select("doc_id").distinct()
    repeated = links.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone, rows = counted(gone, "gone")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    rest = packed.join(F.broadcast(gone) if rows <= SMALL_ROWS else gone.hint("merge"), "doc_id", "left_anti")
    repeated, rows = counted(repeated, "repeated")
    if not rows:
        return rest.select("row.*")
    twice = rest.join(F.broadcast(repeated) if rows <= SMALL_ROWS else repeated.hint("merge"), "doc_id", "left_semi")
    once = rest.join(F.broadcast(repeated) if rows <= SMALL_ROWS else repeated.hint("merge"), "doc_id", "left_anti")
    return once.select("row.*").unionByName(twice.groupBy("doc_id").agg(F.first("row").alias("row")).select("row.*"))
