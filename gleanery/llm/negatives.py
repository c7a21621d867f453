"""Hard negatives by a secondary sort.

Anchors are a stated set of rows, searched against all rows.  Scores go through a shuffle under the key (anchor, descending score, kind, id): the
rows of an anchor meet in one partition, sorted by Spark, and are read once as a stream (``repartition`` and ``sortWithinPartitions``, the
DataFrame form of repartitionAndSortWithinPartitions).  A positive opens a window that reaches down to a share of its score; each negative that
follows goes to all open windows; a window closes when it has enough negatives or a score falls below it.  What the stream holds of an anchor is its
open windows, never its rows.

What is shuffled stays small, and nothing is lost by it.  A task that scores a part of the rows against a block of anchors sends an anchor's
best positives of that part only.  When the first shuffle has told each anchor's positives, a second pass over the rows sends for each window the best
negatives of a part.  A row that is not among the best of its part is not among the best of all.  Blocks of anchors are bounded in bytes and broadcast one
after the other, rows stay where they are: a hot label or vector costs no task more than another, and no pairs of a group are written.

Special cases.  Rows with a null id, label or vector, or a component that is null or not finite, take no part.  Of rows with one id the one with the least label, then the least
vector, counts.  A missing component of a shorter vector counts as 0; components and scores that exceed a long are held at its ends.  Ties of score go
by the smaller id.  An anchor alone, or without positives, gives no rows; so does an empty table.  Columns other than the three named are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.llm.common import partitions
from gleanery.session import counted, new_path, spread, write_out

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: Percent of a positive's score that a negative must reach, and must not exceed.
LOWEST, HIGHEST = 80, 100
#: Bytes of anchors that are broadcast at a time, as 64-bit numbers, and scores that a task holds at a time.
ANCHOR_BYTES = 16 << 20
TILE = 1 << 20
#: Whole numbers up to this are exact as doubles.
EXACT = 1 << 53
MOST = (1 << 63) - 1

PAIRS = "anchor_id long, score long, negative boolean, id long"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_numbers(vector: Column) -> Column:
    """Components times 256, rounded down; null if one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNull(), None).when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def prepared(rows: DataFrame, vec_id: str = "vec_id", label: Column | str = "label", vector: str = "embedding") -> DataFrame:
    """id, label, v (whole numbers) of the rows that take part, each id once."""
    label = F.col(label) if isinstance(label, str) else label
    valid = (spread(rows).select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
                                 whole_numbers(F.col(vector)).alias("v"))
             .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    valid = write_out(valid, "vectors")
    twice, n = counted(valid.groupBy("id").count().where("count > 1").select("id"), "repeated_ids")
    if not n:
        return valid
    least = Window.partitionBy("id").orderBy("label", "v")
    again = valid.join(twice, "id", "left_semi").withColumn("_n", F.row_number().over(least)).where("_n = 1").drop("_n")
    return write_out(valid.join(twice, "id", "left_anti").unionByName(again), "vectors")


def matrix(v: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list array as rows of ``dim`` numbers."""
    sizes = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(v), dim)
    out = np.zeros((len(v), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, held within a long."""
    most = [max(1, abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (rows, anchors)]
    bound = most[0] * most[1] * max(1, rows.shape[1])
    if bound < EXACT:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    if bound <= MOST:
        return rows @ anchors.T
    return np.clip(rows.astype(object) @ anchors.astype(object).T, -MOST - 1, MOST).astype(np.int64)


class Best:
    """The best rows of each window, over the rows a task has seen.

    A window is (anchor, lowest score, highest score); its best rows are those of
    highest score, then of least id.
    """

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> None:
        self.anchor, self.low, self.high, self.most = anchor, low.copy(), high, most
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, first: int, last: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Take up rows (the first axis) for the windows from ``first`` up to ``last`` (the second)."""
        row, window = np.nonzero(allowed & (scores >= self.low[first:last]) & (scores <= self.high[first:last]))
        if not len(row):
            return
        window, score, ids = window + first, scores[row, window], ids[row]
        window = np.concatenate([self.window, window])
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, window))
        window, score, ids = window[order], score[order], ids[order]
        begin = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        rank = np.arange(len(window)) - np.repeat(begin, np.diff([*begin, len(window)]))
        kept = rank < self.most
        full = rank == self.most - 1
        self.low[window[full]] = score[full]  # what scores less is no longer among the best
        self.window, self.score, self.id = window[kept], score[kept], ids[kept]


def best_rows(rows: DataFrame, anchors: dict[str, np.ndarray], windows: tuple[np.ndarray, ...], same: bool, most: int) -> DataFrame:
    """PAIRS: for each window, the best rows of each part of ``rows`` with the label of the anchor, or with another."""
    anchor, low, high = windows
    negative = not same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, dim = Best(anchor, low, high, most), anchors["v"].shape[1]
        ids, labels, vectors = anchors["id"][anchor], anchors["label"][anchor], anchors["v"]
        for batch in batches:
            own, own_labels = (batch.column(i).to_numpy() for i in (0, 1))
            m = matrix(batch.column(2), max(dim, 0))
            for a in range(0, len(anchor), 1024):
                b = min(len(anchor), a + 1024)
                used, place = np.unique(anchor[a:b], return_inverse=True)
                step = max(1, TILE // (b - a))
                for i in range(0, len(own), step):
                    j = i + step
                    scores = products(m[i:j], vectors[used])[:, place]
                    equal = own_labels[i:j, None] == labels[a:b]
                    allowed = equal & (own[i:j, None] != ids[a:b]) if same else ~equal
                    best.add(a, b, scores, allowed, own[i:j])
        # A row may be among the best of several windows of an anchor.
        found = np.unique(np.stack([anchors["id"][anchor[best.window]], best.score, best.id]), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[0]), pa.array(found[1]), pa.array(np.full(found.shape[1], negative)), pa.array(found[2])],
            ["anchor_id", "score", "negative", "id"])

    return rows.select("id", "label", "v").mapInArrow(run, PAIRS)


def sorted_streams(pairs: DataFrame) -> DataFrame:
    """An anchor's pairs in one partition, by descending score; positives before negatives, then by id."""
    return (pairs.repartition(partitions(pairs), "anchor_id")
            .sortWithinPartitions("anchor_id", F.desc("score"), "negative", "id"))


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, int]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)))


def first_positives(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, bool, int]]:
    last, n = None, 0
    for pair in in_order(batches):
        n = n + 1 if pair[0] == last else 1
        last = pair[0]
        if n <= most:
            yield pair


def mined(batches: Iterator[pa.RecordBatch], most: int, lowest: int, highest: int) -> Iterator[tuple]:
    """Rows of FOUND: each positive opens a window for the negatives that follow it in its anchor's stream."""
    last, opened = None, []  # [positive_id, its score, negatives so far]
    for anchor_id, score, negative, one in in_order(batches):
        if anchor_id != last:
            last, opened = anchor_id, []
        if not negative:
            opened.append([one, score, 0])
            continue
        still = []
        for window in opened:
            if 100 * score > highest * window[1]:
                still.append(window)
            elif lowest * window[1] <= 100 * score:
                window[2] += 1
                yield anchor_id, window[0], window[2], one, window[1], score
                if window[2] < most:
                    still.append(window)
        opened = still


def streamed(pairs: DataFrame, schema: str, work) -> DataFrame:
    """Run ``work`` over the sorted streams of anchors, in batches."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = work(batches)
        while some := [row for _, row in zip(range(10_000), rows)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)

    return sorted_streams(pairs).mapInArrow(run, schema)


def shares(score: int, lowest: int, highest: int) -> tuple[int, int]:
    """Least and greatest whole score between two percentages of a score."""
    return max(-MOST - 1, -(-lowest * score // 100)), min(MOST, highest * score // 100)


def collect_anchors(anchors: DataFrame, dim: int) -> dict[str, np.ndarray]:
    """A block of anchors, bounded in bytes by its caller."""
    table = anchors.select("id", "label", "v").toArrow().combine_chunks()
    v = table.column("v").combine_chunks()
    return {"id": table.column("id").to_numpy(), "label": table.column("label").to_numpy(), "v": matrix(v, dim)}


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST, highest: int = HIGHEST, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """FOUND for ``rows`` (id, label, v), as ``prepared`` makes them, whose anchors fulfil ``is_anchor``.

    ``highest`` is at most 100, so that a negative never comes before its positive.
    """
    if not lowest <= highest <= 100:
        raise ValueError("the upper share must be from the lower one to 100")
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "negatives")
    size = rows.where(is_anchor).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("own")).first()
    dim = rows.agg(F.max(F.size("v")).alias("dim")).first()["dim"] or 0
    blocks = max(1, -(-size["n"] * 8 * max(dim, 1) // anchor_bytes))
    anchors = write_out(rows.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "anchors", ["block"])
    spark.createDataFrame([], FOUND).write.parquet(path)
    for block in range(blocks):
        some = collect_anchors(anchors.where(F.col("block") == block), dim)
        n = len(some["id"])
        if not n:
            continue
        everything = np.arange(n), np.full(n, -MOST - 1), np.full(n, MOST)
        pairs = best_rows(rows, some, everything, True, positives)
        chosen = write_out(streamed(pairs, PAIRS, lambda b: first_positives(b, positives)), "positives")
        place = {a: i for i, a in enumerate(some["id"].tolist())}
        # At most ``positives`` rows of each anchor of the block.
        windows = sorted({(place[r["anchor_id"]], *shares(r["score"], lowest, highest)) for r in chosen.collect()})
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            continue
        at, low, high = (np.array(c, np.int64) for c in zip(*windows))
        pairs = chosen.unionByName(best_rows(rows, some, (at, low, high), False, negatives))
        found = streamed(pairs, FOUND, lambda b: mined(b, negatives, lowest, highest))
        found.write.mode("append").parquet(path)
    return spark.read.schema(FOUND).parquet(path)


def report(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the ``embeddings`` table.

    Anchors are the rows with vec_id divisible by 100; rows with vec_id divisible by 7 get another label first.
    """
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(prepared(embeddings, label=label), F.col("id") % ANCHOR_EVERY == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
         s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.k <= 5
   AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5"""
