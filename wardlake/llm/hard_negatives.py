"""Hard-negative mining by a secondary-sort shuffle.

Scores of (anchor, row) pairs are packed into keys (anchor, descending score, kind, id),
dealt by anchor and sorted inside each partition.  An iterator reads the keys of an anchor
once: its first positives open windows of scores, and every later negative goes to the open
windows that it falls in.  It holds a few windows, never an anchor's rows.

So that not all pairs are shuffled, tasks pass on only what can matter.  A first pass over
blocks of anchors and rows finds the scores of each anchor's first positives; in the second,
a task keeps, of its rows, the first positives and the first negatives of each window.  What a task
leaves out has enough rows before it in the same task, so the result is that of all pairs.

Rows that take part, and repeated rows: see ``vectors``; rows without label take no part.  Rows
that share an id: the smallest (label, vector) is the anchor, none of them is its positive
or negative.  Equal scores: positives first, then the smaller id.  A positive with a
score under zero has an empty window.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm import vectors as V
from wardlake.llm.common import stage

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 50, 95

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Anchor, descending score, kind, id: big-endian, each so that bytes sort like numbers.
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_UNPACK, _SIGN = struct.Struct(">QQBQ"), 1 << 63


def packed(anchors: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> np.ndarray:
    keys = np.empty(len(anchors), KEY)
    flip = lambda x: x.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    keys["anchor"], keys["score"], keys["kind"], keys["id"] = flip(anchors), ~flip(scores), kind, flip(ids)
    return keys


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, i = _UNPACK.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, kind, i - _SIGN


def window_of(score: int) -> tuple[int, int]:
    """The least and most whole score n with LEAST * score <= 100 * n <= MOST * score."""
    return -(-LEAST * score // 100), MOST * score // 100


class Anchors(V.Block):
    """A block of anchors; ``best`` are the first positives among the rows so far."""

    def __init__(self, width: int):
        self.width, self.parts = width, []

    def queries(self, part):
        self.parts.append(part)

    def begin(self, n: int) -> None:
        held = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        self.held = held
        self.ids, self.labels = (np.asarray(V.column(held, c)) for c in ("vec_id", "label"))
        self.cells = V.matrix(V.column(held, "cells"), self.width)
        self.best = np.full((len(self.ids), n), V.NONE), np.zeros((len(self.ids), n), np.int64)
        self.parts = None

    def slices(self, part) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row ids, scores, whether the label is the anchor's; own rows have no score."""
        if self.parts:
            self.begin(POSITIVES)
        if self.parts is not None:  # no anchors in this block
            return
        ids, labels = (np.asarray(V.column(part, c)) for c in ("vec_id", "label"))
        cells = V.matrix(V.column(part, "cells"), self.width)
        step = max(1, V.SCORES // len(self.ids))
        for a in range(0, len(ids), step):
            scores = V.products(self.cells, cells[a:a + step])
            scores[V.own_pairs(self.ids, ids[a:a + step])] = V.NONE
            yield ids[a:a + step], scores, self.labels[:, None] == labels[None, a:a + step]

    def better(self, held, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray):
        """The first of those held and the fitting new ones."""
        every = np.hstack((held[0], np.where(fits, scores, V.NONE)))
        names = np.hstack((held[1], np.broadcast_to(ids, (len(every), len(ids)))))
        return V.highest(every, names, held[0].shape[1])


class Positives(Anchors):
    """Scores of the first positives of each anchor in a block of rows."""

    def rows(self, part):
        for ids, scores, same in self.slices(part):
            self.best = self.better(self.best, scores, ids, same)
        return iter(())

    def end(self):
        if self.parts is None:
            q, j = np.nonzero(self.best[0] != V.NONE)
            yield [pa.array(self.ids[q]), pa.array(self.best[0][q, j])]


class Pairs(Anchors):
    """Packed keys of the first positives and of each window's first negatives in a block of rows."""

    def begin(self, n):
        super().begin(n)
        self.windows = []
        scores = V.column(self.held, "positives").to_pylist()
        none = V.MOST, -V.MOST
        for j in range(POSITIVES):
            ends = np.array([window_of(s[j]) if s and j < len(s) else none for s in scores], np.int64)
            held = np.full((len(scores), NEGATIVES), V.NONE), np.zeros((len(scores), NEGATIVES), np.int64)
            self.windows.append([ends, held])

    def rows(self, part):
        for ids, scores, same in self.slices(part):
            self.best = self.better(self.best, scores, ids, same)
            for window in self.windows:
                fits = ~same & (scores >= window[0][:, :1]) & (scores <= window[0][:, 1:]) & (scores != V.NONE)
                some = np.flatnonzero(fits.any(axis=1))
                if len(some):
                    held = self.better((window[1][0][some], window[1][1][some]), scores[some], ids, fits[some])
                    window[1][0][some], window[1][1][some] = held
        return iter(())

    def end(self):
        if self.parts is not None:
            return
        keys = [self.keys(self.best, 0)] + [np.unique(np.concatenate([self.keys(held, 1) for _, held in self.windows]))]
        yield [pa.array([k.tobytes() for k in np.concatenate(keys).astype(KEY)], pa.binary())]  # concatenate swaps bytes

    def keys(self, held, kind):
        q, j = np.nonzero(held[0] != V.NONE)
        return packed(self.ids[q], held[0][q, j], kind, held[1][q, j])


def mined(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
    """Rows of ``RESULT`` from the sorted keys of whole anchors, in one pass."""
    now, windows = None, []
    for key, _ in keys:
        anchor, score, kind, i = unpacked(key)
        if anchor != now:
            now, windows = anchor, []
        if kind == 0:
            if len(windows) < POSITIVES:
                windows.append([i, score, *window_of(score), 0])
            continue
        for window in windows:
            positive, positive_score, least, most, n = window
            if least <= score <= most and n < NEGATIVES:
                window[4] = n + 1
                yield anchor, positive, n + 1, i, positive_score, score


def mine(rows: DataFrame, anchors: DataFrame, label: Column | None = None) -> DataFrame:
    """The first negatives of each anchor's first positives (both tables: vec_id, label, embedding;
    ``label`` is the label to use)."""
    label = F.col("label") if label is None else label
    spark = rows.sparkSession
    own = stage(V.one_per_id(V.whole_vectors(anchors, label).filter("label is not null")), "anchors")
    every = V.smallest_ids(V.whole_vectors(rows, label).filter("label is not null"), max(POSITIVES, NEGATIVES) + 1)
    every = stage(every.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    scores = V.in_blocks(own, every, Positives, "vec_id long, score long")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"))
    scores = (scores.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= POSITIVES)
              .groupBy("vec_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("positives")))
    known = stage(own.join(scores, "vec_id"), "positives")  # no positives: no result
    keys = stage(V.in_blocks(known, every, Pairs, "key binary"), "keys")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(
        n, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(dealt.mapPartitions(mined), RESULT)


#: The query of the contract: anchors are rows whose id is divisible by EVERY; some labels are moved on.
EVERY, MOVED = 50, 7


def label_used() -> Column:
    label = F.col("label").cast("decimal(20,0)")
    return F.when(F.col("vec_id") % MOVED == 0, (label + 1) % 10).otherwise(label)


def digest(embeddings: DataFrame) -> DataFrame:
    return mine(embeddings, embeddings.filter(F.col("vec_id") % EVERY == 0), label_used())


SQL = f"""WITH v AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  a AS (SELECT vec_id AS anchor_id, m.label AS anchor_label, m.c AS a FROM (
          SELECT vec_id, min({{'label': label, 'c': c}}) AS m FROM v WHERE vec_id % {EVERY} = 0 GROUP BY 1) x),
  s AS (SELECT anchor_id, vec_id, label = anchor_label AS same,
          CAST(coalesce(list_sum(list_transform(list_zip(a, c), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
        FROM a JOIN v ON anchor_id <> vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
          row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
  n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
          row_number() OVER (PARTITION BY anchor_id, positive_id, nth ORDER BY score DESC, vec_id) AS rank
        FROM p JOIN s USING (anchor_id)
        WHERE nth <= {POSITIVES} AND NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
  FROM n WHERE rank <= {NEGATIVES}"""
