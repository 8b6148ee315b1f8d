"""Vectors as whole numbers, and jobs over every query against every row in blocks.

Rows take part that have an id and a vector without null or non-finite components.  A
component x becomes floor(256 * x), x as double (beyond 64 bits: the nearest long).
Rows that repeat id, label and vector count once.  Of vectors of different length, the
shorter is filled with zeros.  A score beyond 64 bits is the nearest of +-(2^63 - 1).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of query vectors that a task holds.
QUERY_VALUES = 1 << 21
#: Rows of a block: the most, and the least that is worth a task of its own.
BLOCK_ROWS, LEAST_ROWS = 1 << 20, 1 << 9
#: Scores that a task works on at once.
SCORES = 1 << 21
#: The lowest score stands for "none"; scores go from one above it.
NONE = -(1 << 63)
MOST = (1 << 63) - 1


def whole_vectors(df: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id``, (``label``,) ``cells`` of the rows that take part, each once."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cells = F.transform(vector, lambda x: F.floor(x * 256.0))
    rows = df.filter(F.col("vec_id").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       *([label.cast("long").alias("label")] if label is not None else []), cells.alias("cells"))
    return rows


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the ``n`` smallest ids of each (label and) vector.  More copies of a
    vector cannot be among the first n of anything, as ties go to the smaller id.  Map tasks
    cut a large group of copies before the shuffle."""
    same = [c for c in rows.columns if c != "vec_id"]
    order = Window.partitionBy(*same).orderBy("vec_id")
    return (rows.distinct().withColumn("nth", F.row_number().over(order))
            .filter(F.col("nth") <= n).drop("nth"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share an id, the one of the smallest (label and) vector."""
    rest = [c for c in rows.columns if c != "vec_id"]
    return rows.groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("least")).select("vec_id", "least.*")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, filled with zeros; values beyond its width,
    which would only meet zeros, are left out."""
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = np.asarray(lists.flatten())
    if len(lists) and (lengths == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths)[at < width], at[at < width]] = flat[at < width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with the rows of ``b``."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1] < 1 << 53:
        return (x @ y.T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[max(-MOST, min(MOST, int(v))) for v in row] for row in exact], np.int64).reshape(len(a), len(b))


def own_pairs(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) of equal ids; the ids of ``queries`` differ."""
    order = np.argsort(queries)
    at = np.searchsorted(queries, rows, sorter=order)
    found = np.flatnonzero((at < len(queries)) & (queries[order[np.minimum(at, len(queries) - 1)]] == rows))
    return order[at[found]], found


def highest(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n highest scores of each row with their ids, highest first, ties to the first
    column; ``NONE`` where there are fewer.  Overwrites ``scores``."""
    every = np.arange(len(scores))
    top, which = np.full((len(scores), n), NONE, np.int64), np.zeros((len(scores), n), np.int64)
    for j in range(n if scores.shape[1] else 0):
        at = scores.argmax(axis=1)
        top[:, j], which[:, j] = scores[every, at], ids[every, at] if ids.ndim == 2 else ids[at]
        scores[every, at] = NONE
    return top, which


class Block:
    """What a task does with one block of queries and one block of rows."""

    def queries(self, part: pa.RecordBatch) -> None:
        """Queries of the block; all of them come before the rows."""

    def rows(self, part: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        """Rows of the block, in the order of their ids."""
        return iter(())

    def end(self) -> Iterator[list[pa.Array]]:
        return iter(())


def in_blocks(queries: DataFrame, rows: DataFrame, make: Callable[[int], Block], schema: str,
              vector: str = "cells") -> DataFrame:
    """Bring every query together with every row.  Queries and rows are dealt into blocks, and
    each pair of blocks goes to one task: it holds the queries (a bounded number of values) and
    streams the rows past them in the order of ``vec_id``.  A query is copied once per block of
    rows and a row once per block of queries; nothing is broadcast."""
    conf = queries.sparkSession.conf
    n_queries, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    n_rows = rows.count()
    across = max(1, math.ceil(n_queries * max(1, width) / QUERY_VALUES))
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), 2 * queries.sparkSession.sparkContext.defaultParallelism)
    down = max(1, math.ceil(n_rows / BLOCK_ROWS), min(math.ceil(tasks / across), math.ceil(n_rows / LEAST_ROWS)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    left = queries.withColumns({"side": F.lit(0), "cell": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
    left = left.withColumn("cell", F.col("cell") * across + dealt("vec_id", across))
    right = rows.withColumns({"side": F.lit(1), "cell": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    right = right.withColumn("cell", F.col("cell") + dealt("rid", down) * across)
    both = left.unionByName(right, allowMissingColumns=True)
    out = T._parse_datatype_string(schema)
    names = out.fieldNames()

    def run(batches):
        work = cell = None
        ready = lambda found: [pa.RecordBatch.from_arrays(x, names=names) for x in found if len(x[0])]
        for batch in batches:
            cells, sides = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("cell", "side"))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    if work:
                        yield from ready(work.end())
                    work, cell = make(width), cells[a]
                if sides[a] == 0:
                    work.queries(batch.slice(a, b - a))
                else:
                    yield from ready(work.rows(batch.slice(a, b - a)))
        if work:
            yield from ready(work.end())

    return (both.repartition(across * down, "cell").sortWithinPartitions("cell", "side", "vec_id")
            .mapInArrow(run, out))


def column(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))
