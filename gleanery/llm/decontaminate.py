"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are cut into blocks of bounded size; a task per block builds a suffix
automaton that accepts every run of consecutive words of the block's items.  Documents
are streamed past the automata: the longest match that ends at each word tells which
windows occur there and which words they cover.  No shuffle moves document text.

Rules.  A text is lower-cased (A-Z) and cut into words of ASCII letters, digits and
characters beyond ASCII.  A window is ``window`` consecutive words of an item; an item of
fewer words, but not none, is one window.  A document word inside any occurrence of a
window is hit.  A document is contaminated if it has hits and at least ``coverage`` of its
words are hit.

Special cases.  A null or empty text has no words.  Items without words are ignored, items
with the same id count once, a null item id is written as an empty string.  Each row of
the documents is judged by itself, so repeated rows give repeated results, and a
null doc_id is carried along.  Empty tables give empty results or no hits.  Further
columns are carried along, whatever their names.
"""

from __future__ import annotations

import itertools
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gleanery.llm.common import ALNUM, longs, with_made
from gleanery.session import counted, write_out

WINDOW = 13
COVERAGE = (1, 20)
#: Words of an automaton.  A block of items has so many on average; it is what a worker holds.
BLOCK_WORDS = 200_000
#: Blocks that one pass over the documents uses; more blocks mean more passes.
BLOCKS_PER_PASS = 4
#: Documents' runs of words are looked up by so many words first.
GRAM = 4
GRAM_BITS = 22

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.LongType()))])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def gram_codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code of every ``width`` consecutive ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(width):
        code = (code ^ ids[i:i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


class Automaton:
    """Suffix automaton over the words of several items, with their windows marked.

    A state stands for the runs of words of length ``length[link] < n <= length`` that
    share their end positions; ``windows`` holds, for a state, its windows' lengths and items.
    When it is built, the transitions of all states lie in two arrays, sorted by state and word.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[int, dict[int, set[str]]] = {}
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            coded.append((item, ids))
            state = 0
            for word in ids:
                state = self._extend(state, word)
        for item, ids in coded:
            self._mark(item, ids, min(window, len(ids)))
        self.least = min((n for at in self.windows.values() for n in at), default=1)
        # The nearest state up the links that has windows of its own.
        self.above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = up if up in self.windows else self.above[up]
        self._pack()
        self.width = min(GRAM, self.least)
        self.codes = np.unique(np.concatenate(
            [gram_codes(np.array(ids, np.int64), self.width) for _, ids in coded] or [np.zeros(0, np.uint64)]))

    def _pack(self) -> None:
        self.first, self.words, self.targets = array("i", [0]), array("i"), array("i")
        for following in self.next:
            for word in sorted(following):
                self.words.append(word)
                self.targets.append(following[word])
            self.first.append(len(self.words))
        self.link, self.length, self.above = (array("i", x) for x in (self.link, self.length, self.above))
        del self.next

    def step(self, state: int, word: int) -> int:
        """The state that ``word`` leads to, -1 without one."""
        end = self.first[state + 1]
        at = bisect_left(self.words, word, self.first[state], end)
        return self.targets[at] if at < end and self.words[at] == word else -1

    def dump(self) -> bytes:
        """Plain data, which any worker can load."""
        return pickle.dumps(self.__dict__)

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        made = cls.__new__(cls)
        made.__dict__.update(pickle.loads(blob))
        return made

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, state: int, word: int, longer: int) -> int:
        """The part of ``longer`` that is one word longer than ``state``, as a state of its own."""
        part = self._state(self.length[state] + 1, self.link[longer], dict(self.next[longer]))
        self.link[longer] = part
        while state != -1 and self.next[state].get(word) == longer:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            exact = self.length[known] == self.length[last] + 1
            return known if exact else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            known = self.next[state][word]
            exact = self.length[known] == self.length[state] + 1
            self.link[new] = known if exact else self._split(state, word, known)
        return new

    def _mark(self, item: str, ids: list[int], n: int) -> None:
        state = 0
        for i, word in enumerate(ids):
            state = self.next[state][word]
            if i + 1 >= n:
                at = state
                while self.length[self.link[at]] >= n:
                    at = self.link[at]
                self.windows.setdefault(at, {}).setdefault(n, set()).add(item)

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, state, length) of the longest match at each word where it has a window's length."""
        state = length = 0
        for end, word in enumerate(ids):
            following = self.step(state, word)
            while state and following < 0:
                state = self.link[state]
                length = self.length[state]
                following = self.step(state, word)
            state = max(following, 0)
            length = length + 1 if state else 0
            if length >= self.least:
                yield end, state, length

    def found(self, state: int, length: int) -> Iterator[tuple[int, set[str]]]:
        """Windows that end where a match of this state and length ends."""
        for n, items in self.windows.get(state, {}).items():
            if n <= length:
                yield n, items
        state = self.above[state]
        while state > 0:
            yield from self.windows[state].items()
            state = self.above[state]

    def candidates(self) -> np.ndarray:
        """Bitmap over the top bits of the codes."""
        seen = np.zeros(1 << GRAM_BITS, bool)
        seen[self.codes >> np.uint64(64 - GRAM_BITS)] = True
        return seen


class Scanner:
    """Streams texts past some automata, which a task loads when it begins and lets go of when it ends."""

    def __init__(self, shared: Broadcast) -> None:
        self.shared, self.automata = shared, None

    def scan(self, texts: list[bytes | None]):
        if self.automata is None:
            self.automata = [(a, a.candidates()) for a in map(Automaton.load, self.shared.value)]
        words, counts = [], []
        for text in texts:
            own = words_of(text)
            counts.append(len(own))
            words += own
            words.append(b"")  # no word: matches end with the document
        starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        hits: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        longest = [0] * len(texts)
        for automaton, seen in self.automata:
            ids = np.fromiter(map(automaton.vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))
            codes = gram_codes(ids, automaton.width)
            at = np.flatnonzero(seen[codes >> np.uint64(64 - GRAM_BITS)])
            at = at[np.isin(codes[at], automaton.codes)]
            if not len(at):
                continue
            cuts = np.flatnonzero(np.diff(at) != 1)
            firsts, lasts = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
            ends = lasts + automaton.width
            for first, end in zip(firsts.tolist(), ends.tolist()):
                if end - first < automaton.least:
                    continue
                for last, state, length in automaton.matches(ids[first:end].tolist()):
                    for n, ids_found in automaton.found(state, length):
                        place = first + last + 1
                        doc = int(np.searchsorted(starts, place - 1, "right")) - 1
                        hits[doc].append((place - n - int(starts[doc]), place - int(starts[doc])))
                        items[doc] |= ids_found
                        longest[doc] = max(longest[doc], length)
        return counts, [merged(h) for h in hits], items, longest


def merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Union of [start, end) spans, as a flat list start, end, start, end."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[int]]:
    """(block, blob) rows of pickled automata, one per block, and the blocks' numbers.

    Items of under GRAM words have blocks of their own, so that the others can be looked up by GRAM words.
    """
    size = T.StructType([T.StructField("n", T.LongType())])
    cut, rows = counted(
        with_made(items, [F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")], "text",
                  size, lambda _, texts: {"n": longs([len(words_of(t)) for t in texts])})
        .select("row.item", "row.text", "made.n").where("n > 0").dropDuplicates(["item", "text"]), "items")
    if not rows:
        return cut, []
    total = cut.agg(F.sum("n")).first()[0]
    blocks = -(-total // block_words)
    numbered = cut.withColumn("block", (
        (F.least("n", F.lit(GRAM)) - 1) * blocks + F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).cast("long"))

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        pairs = zip(group.column("item").to_pylist(), group.column("text").cast(pa.binary()).to_pylist())
        made = Automaton(sorted((i, words_of(t)) for i, t in pairs), window)
        return pa.table({"block": longs([key[0].as_py()]), "blob": pa.array([made.dump()], pa.binary())})

    built = write_out(numbered.groupBy("block").applyInArrow(build, "block long, blob binary"), "automata")
    return built, sorted(r[0] for r in built.select("block").collect())


def scan(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = WINDOW,
         coverage: tuple[int, int] = COVERAGE, block_words: int = BLOCK_WORDS,
         blocks_per_pass: int = BLOCKS_PER_PASS, max_length: int | None = None) -> DataFrame:
    """Struct columns ``row`` (the kept columns of the document, all by default) and ``hits``.

    ``hits`` has n_words, n_hit, longest (longest match with a window in it), items (sorted
    ids), spans (hit words, as start, end, start, end), contaminated; with a ``max_length`` also text, without the spans
    of more words.
    """
    spark = docs.sparkSession
    built, blocks = automata(items, window, block_words)
    keep = docs.columns if keep is None else keep
    now = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))
    done = None
    for i in range(0, max(1, len(blocks)), blocks_per_pass):
        chosen = blocks[i:i + blocks_per_pass]
        blobs = [r[0] for r in built.where(F.col("block").isin(chosen)).orderBy("block").select("blob").collect()] if chosen else []
        shared = spark.sparkContext.broadcast(blobs)
        given = None if done is None else F.col("made")

        scanner, last = Scanner(shared), i + blocks_per_pass >= len(blocks)  # each task gets its own

        def make(before, texts, scanner=scanner, last=last):
            counts, spans, found, longest = scanner.scan(texts)
            for d, old in enumerate(before):
                if old is not None:
                    spans[d] = merged(list(zip(spans[d][::2], spans[d][1::2])) + list(zip(old["spans"][::2], old["spans"][1::2])))
                    found[d] |= set(old["items"])
                    longest[d] = max(longest[d], old["longest"])
            rest = {} if max_length is None else {"text": pa.array(
                [shortened(t, s, max_length) if last else None for t, s in zip(texts, spans)], pa.binary()).cast(pa.string())}
            return rest | {
                "n_words": longs(counts), "n_hit": longs([sum(s[1::2]) - sum(s[::2]) for s in spans]),
                "longest": longs(longest), "items": pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.int64()))}

        made = HITS if max_length is None else T.StructType([*HITS, T.StructField("text", T.StringType())])
        done = with_made(now, ["row"] if last else ["row", "text"], "text", made, make, given)
        if not last:
            now = write_out(done, "scan").select("row.row", "row.text", "made")
    hit, words = F.col("made.n_hit"), F.col("made.n_words")
    return done.select(F.col("row.row").alias("row"), F.struct(
        "made.*", ((hit > 0) & (hit * coverage[1] >= words * coverage[0])).alias("contaminated")).alias("hits"))


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    """Text without the words of the spans and what stands between them."""
    marked = text.translate(ALNUM)
    places, at = [], 0
    for word in marked.split():
        at = marked.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def shortened(text: bytes | None, spans: list[int], max_length: int) -> bytes | None:
    """Text without the spans of more than ``max_length`` words."""
    long = [x for a, b in zip(spans[::2], spans[1::2]) if b - a > max_length for x in (a, b)]
    return cut_spans(text, long) if long else text


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: tuple[int, int] = COVERAGE,
                  max_length: int | None = None) -> DataFrame:
    """Documents, in their columns, without contamination.

    Documents beyond the coverage limit go.  From the others, spans of hit words longer
    than ``max_length`` words are cut; without a length limit they stay as they are.
    """
    judged = scan(docs, items, window=window, coverage=coverage, max_length=max_length).where("NOT hits.contaminated")
    text = F.col("row.`text`" if max_length is None else "hits.text")
    return judged.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    hits = scan(docs, items, keep=["doc_id"])
    return hits.select(
        "row.doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), "hits.contaminated", "hits.longest")

