"""Exact top-k search by a vector-approximation file.

Every vector is also written as one short code per component: the number of the cell, of
2^BITS cells that hold about as many values each, in which the component lies.  A search

1. scans the codes only; the ends of the cells bound each inner product from both sides.  A row
   whose upper bound is under the k-th highest lower bound of a query is out;
2. reads exact vectors of what is left in the order of their upper bounds, a few at first and
   four times as many each round, until the k-th score reached is over the bound of all unread rows.

Ties are never cut: a row whose bound equals the k-th score is read.  Rows that take part,
and repeated rows: see ``vectors``.  Of rows that share an id, the smallest vector is the query, and
none of them is a result of it.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm import vectors as V
from wardlake.llm.common import stage

#: Bits of a code: a byte, against four or eight bytes of an exact component.
BITS = 8
#: Rows read in the first round, as a multiple of k.
FIRST_READ = 4

BOUNDS = "query_id long, rid long, vec_id long, lower double, upper double"


def cell_ends(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of each cell of each component (component x cell), from
    quantiles over all rows; their size depends on the width of the vectors only."""
    n = 1 << BITS
    found = (rows.select(F.posexplode("cells").alias("at", "value")).groupBy("at")
             .agg(F.min("value").alias("least"), F.max("value").alias("most"),
                  F.percentile_approx("value", [i / n for i in range(1, n)], 2000).alias("cuts"))
             .orderBy("at").collect())
    low, high = np.zeros((2, len(found), n), np.float64)
    for i, r in enumerate(found):
        # rows with shorter vectors have zeros here
        least, most = min(r["least"], 0), max(r["most"], 0)
        cuts = [min(max(c, least), most) for c in r["cuts"]]
        low[i], high[i] = [least, *cuts], [*(max(c - 1, least) for c in cuts), most]
    return low, high


def codes(rows: DataFrame, low: np.ndarray) -> DataFrame:
    """``rid``, ``vec_id`` and ``codes``: a byte per component with its cell."""
    width, cuts = len(low), [x[1:].copy() for x in low]

    def run(batches):
        for batch in batches:
            values = V.matrix(V.column(batch, "cells"), width)
            out = np.empty(values.shape, np.uint8)
            for i, c in enumerate(cuts):
                out[:, i] = np.searchsorted(c, values[:, i].astype(np.float64), side="right")
            yield pa.RecordBatch.from_arrays(
                [V.column(batch, "rid"), V.column(batch, "vec_id"), pa.array([r.tobytes() for r in out], pa.binary())],
                names=["rid", "vec_id", "codes"])

    return rows.mapInArrow(run, "rid long, vec_id long, codes binary")


class Scan(V.Block):
    """Bounds of every (query, row) from codes; passes on what can be among the first k."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.ids, self.parts, self.kth = np.zeros(0, np.int64), [], None

    def queries(self, part):
        self.ids = np.concatenate((self.ids, np.asarray(V.column(part, "vec_id"))))
        self.parts.append(V.matrix(V.column(part, "cells"), len(self.low)).astype(np.float64))

    def rows(self, part):
        if not len(self.ids):
            return
        if self.kth is None:
            q = np.concatenate(self.parts)
            self.signed = np.hstack((np.maximum(q, 0), np.minimum(q, 0)))
            self.best = np.full((len(q), self.k), -np.inf)
            # beyond 2^53 the sums are rounded
            reach = np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1, initial=0)
            self.slack = np.where(reach < 2.0**53, 0, reach * 2.0**-40)[:, None]
            self.kth = True
        ids, rids = (np.asarray(V.column(part, c)) for c in ("vec_id", "rid"))
        raw = np.frombuffer(b"".join(V.column(part, "codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        step = max(1, V.SCORES // len(self.ids))
        for a in range(0, len(ids), step):
            code, each = raw[a:a + step], np.arange(len(self.low))
            low, high = self.low[each, code], self.high[each, code]
            upper = np.clip(self.signed @ np.hstack((high, low)).T + self.slack, -2.0**63, 2.0**63)
            lower = np.clip(self.signed @ np.hstack((low, high)).T - self.slack, -2.0**63, 2.0**63)
            upper[own := V.own_pairs(self.ids, ids[a:a + step])] = -np.inf
            lower[own] = -np.inf
            every = np.hstack((self.best, lower))
            every.partition(every.shape[1] - self.k, axis=1)
            self.best = every[:, -self.k:]
            q, r = np.nonzero((upper >= self.best.min(axis=1)[:, None]) & (upper > -np.inf))
            yield [pa.array(x) for x in (self.ids[q], rids[a + r], ids[a + r], lower[q, r], upper[q, r])]


def scored(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Exact scores of (query_id, rid): reads these rows' vectors."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("cells").alias("a"))
    joined = pairs.join(rows.select("rid", F.col("cells").alias("b")), "rid").join(q, "query_id")

    def run(batches):
        for batch in batches:
            a, b = V.column(batch, "a"), V.column(batch, "b")
            width = max([0, *np.asarray(pc.list_value_length(a)), *np.asarray(pc.list_value_length(b))])
            x, y = V.matrix(a, width), V.matrix(b, width)
            if np.abs(x.astype(float)).max(initial=0) * np.abs(y.astype(float)).max(initial=0) * width < 1 << 53:
                score = (x * y).sum(axis=1)
            else:
                score = [max(-V.MOST, min(V.MOST, int(s))) for s in (x.astype(object) * y.astype(object)).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([V.column(batch, "query_id"), V.column(batch, "vec_id"),
                                              pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return joined.select("query_id", "vec_id", "a", "b").mapInArrow(run, "query_id long, vec_id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidates(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Rows that can be among the first k of a query by their codes, numbered (``nth``) from the
    highest upper bound down."""
    low, high = cell_ends(rows)
    approximations = stage(codes(rows, low), "codes")
    found = stage(V.in_blocks(queries, approximations, lambda width: Scan(k, low, high), BOUNDS), "bounds")
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"), "rid")
    kth = (found.withColumn("place", F.row_number().over(by_lower)).filter(F.col("place") <= k)
           .groupBy("query_id").agg(F.min(F.when(F.col("place") == k, F.col("lower"))).alias("floor")))
    by_upper = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "rid")
    return (found.join(kth, "query_id").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
            .withColumn("nth", F.row_number().over(by_upper)).drop("floor", "lower"))


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of the highest inner product with each query (both tables: vec_id, embedding):
    query_id, rank, vec_id, score."""
    own = stage(V.one_per_id(V.whole_vectors(queries)), "queries")
    exact = V.smallest_ids(V.whole_vectors(rows), k + 1).withColumn("rid", F.monotonically_increasing_id())
    exact = stage(exact, "vectors")
    bounds = stage(candidates(own, exact, k), "candidates")
    done, at, step = None, 0, FIRST_READ * k
    open_ = bounds
    while True:
        now = scored(open_.filter(F.col("nth").between(at + 1, at + step)).select("query_id", "rid", "vec_id"), own, exact)
        done = stage(first(done.select(*now.columns).unionAll(now) if done else now, k), "scores")
        at, step = at + step, 4 * step
        kth = done.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
        # a score beyond 2^53 is rounded here, so look a little lower
        reached = F.col("kth") - F.abs("kth") * 2.0**-50
        open_ = (bounds.filter(F.col("nth") > at).join(kth, "query_id", "left")
                 .filter(F.col("kth").isNull() | (F.col("upper") >= reached)).drop("kth"))
        if open_.isEmpty():
            return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The query of the contract: rows whose id is divisible by EVERY, against all rows.
EVERY, K = 50, 5


def digest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.filter(F.col("vec_id") % EVERY == 0), K)


SQL = f"""WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  q AS (SELECT vec_id AS query_id, min(c) AS a FROM v WHERE vec_id % {EVERY} = 0 GROUP BY 1),
  s AS (SELECT query_id, vec_id,
          CAST(coalesce(list_sum(list_transform(list_zip(a, c), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
        FROM q JOIN v ON query_id <> vec_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s QUALIFY rank <= {K}"""
