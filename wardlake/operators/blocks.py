"""Exact top k of many queries against a corpus that is never shuffled.

Queries are written as a table of numbered blocks in the shared folder; neither the driver nor a broadcast
holds them.  A task reads its documents once, in slabs of bounded size, takes each slab past every
block, with matrix products over Arrow batches, and keeps only the best k per query and slab.
More queries mean more blocks; the corpus is scanned once, and a block is read once a slab.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardlake.session import scratch_dir

#: Cells of the largest matrix that a task holds (8 bytes each).
CELLS = 1 << 22
#: Cells of the matrices of one step: a step holds several, and lists of their best cells.
STEP_CELLS = 1 << 20
#: Bytes of documents that a task holds.
SLAB_BYTES = 1 << 25
RANK_DIGITS = 9


class Best:
    """The best k documents of each query so far: highest rounded score, then lowest id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.rows: tuple[np.ndarray, ...] | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: documents x queries, -inf where a document does not count."""
        keys = np.round(scores, RANK_DIGITS)
        keys[np.isnan(keys)] = -np.inf
        floor = self.floor
        if len(keys) > self.k:  # what lies below the k-th best of these documents cannot stay
            floor = np.maximum(floor, np.partition(keys, len(keys) - self.k, axis=0)[len(keys) - self.k])
        d, q = np.nonzero((keys >= floor) & (keys > -np.inf))
        if not len(d):
            return
        new = (q, keys[d, q], scores[d, q], ids[d])
        rows = new if self.rows is None else tuple(np.concatenate(p) for p in zip(self.rows, new, strict=True))
        order = np.lexsort((rows[3], -rows[1], rows[0]))
        place = np.arange(len(order)) - np.searchsorted(rows[0][order], rows[0][order])
        self.rows = tuple(x[order[place < self.k]] for x in rows)
        last = order[place == self.k - 1]
        self.floor[rows[0][last]] = rows[1][last]


def block_count(n: int, values: int, shared_width: bool) -> int:
    """Blocks for which a block's rows times its distinct values stay near CELLS: the rows have all
    their values in common (vectors), or at worst none (terms)."""
    return max(1, math.ceil(values / CELLS if shared_width else math.sqrt(n * values / CELLS)))


def write_blocks(asked: DataFrame, qid: str, width: str, shared_width: bool) -> tuple[str, int]:
    """Write the queries by block number; the folder and the number of blocks (0: no queries).  Only two
    counts come to the driver."""
    n, values = asked.agg(F.count(F.lit(1)), F.sum(F.size(width))).first()
    if not n:
        return "", 0
    blocks = block_count(n, values or 0, shared_width)
    folder = f"{scratch_dir(asked.sparkSession, 'query-blocks')}-{uuid.uuid4().hex}"
    (asked.withColumn("block", F.pmod(F.xxhash64(qid), F.lit(blocks)).cast("int")).repartition(blocks, "block")
     .write.partitionBy("block").parquet(folder))
    return folder, blocks


def opened(uri: str):
    """File system and path of a place in the shared folder, for a task."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def read_block(folder: str, number: int) -> pa.Table | None:
    """One block, read by a task from the shared folder; None where no query fell into it."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileType

    files, path = opened(folder)
    at = f"{path}/block={number}"
    if files.get_file_info(at).type == FileType.NotFound:
        return None
    return ds.dataset(at, filesystem=files, format="parquet").to_table()


def slabs(batches, limit: int) -> Iterator[pa.Table]:
    """Record batches in tables of at least ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def top_k(corpus: DataFrame, asked: DataFrame, qid: str, did: str, k: int, width: str, scorer: Callable,
          shared_width: bool = False) -> DataFrame:
    """(qid, did, score): the best k per query and slab of documents.

    ``asked`` has one row per query and ``width``, a list whose distinct values make the columns of a
    block.  ``scorer(block)`` gives the number of documents to score at once and a function (documents)
    -> scores.  Column 0 of ``corpus`` is the document id.
    """
    spark = corpus.sparkSession
    schema = T.StructType([T.StructField(qid, asked.schema[qid].dataType), T.StructField(did, corpus.schema[did].dataType),
                           T.StructField("score", T.DoubleType())])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    folder, blocks = write_blocks(asked, qid, width, shared_width)
    if not blocks:
        return spark.createDataFrame([], schema)
    names, limit = schema.names, SLAB_BYTES

    def run(batches):
        ready: dict[int, tuple] = {}
        for slab in slabs(batches, limit):
            docs = slab.to_batches()
            for number in range(blocks):
                if number not in ready:
                    ready.clear()  # one block at a time
                    block = read_block(folder, number)
                    ready[number] = None if block is None else (block.column(qid).to_pylist(), *scorer(block))
                if ready[number] is None:
                    continue
                ids, step, score = ready[number]
                best = Best(len(ids), k)
                for batch in docs:
                    for at in range(0, batch.num_rows, step):
                        part = batch.slice(at, step)
                        best.add(score(part), np.asarray(part.column(0).to_pylist()))
                if best.rows is not None:
                    q, _, scores, found = best.rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in q.tolist()], types[0]), pa.array(found.tolist(), types[1]),
                         pa.array(scores, types[2])], names=names)

    return corpus.mapInArrow(run, schema)


def cells_of(block: pa.Table, terms: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a block, and for each listed term its number and its query's."""
    lists = block.column(terms).combine_chunks()
    coded = lists.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    return coded.dictionary, np.asarray(coded.indices), of


def listed(block: pa.Table, name: str) -> np.ndarray:
    return np.asarray(block.column(name).combine_chunks().flatten())


def term_matrix(lists: pa.ListArray, vocabulary: pa.Array, values: np.ndarray | None = None) -> np.ndarray:
    """Rows x vocabulary: 1, or the value beside the term, where a row lists it
    (terms are distinct within a row)."""
    out = np.zeros((len(lists), len(vocabulary)))
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    known = term >= 0
    out[row[known], term[known]] = 1.0 if values is None else values[known]
    return out


def dense(cells: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """A matrix from (rows, columns, values)."""
    out = np.zeros(shape)
    out[cells[0], cells[1]] = cells[2]
    return out


def step_for(*widths: int) -> int:
    return max(1, min(CELLS, STEP_CELLS) // max(*widths, 1))
