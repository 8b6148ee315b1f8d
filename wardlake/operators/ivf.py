"""Approximate vector search by inverted-file cells (J3): cosine top k that reads only the cells
near a query.

The vectors are clustered (k-means by cosine, fitted on at most SAMPLE rows, every row indexed) and
written as a table partitioned by cell.  A query is searched in its nearest cells only; there all
vectors are scored exactly.  How many cells that takes is measured when the index is built: on
a sample of its own vectors, the smallest number whose mean recall reaches RECALL.

Cells may be uneven: a large one is written as several files and read by several tasks.  Queries
reach the tasks as blocks written by cell, as in ``blocks``.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardlake import constants as K
from wardlake.operators import blocks as B
from wardlake.operators.retrieval import cosine_topk
from wardlake.session import scratch_dir, write_table

#: Rows that the cells are fitted on, and the most cells.
SAMPLE, MOST_CELLS = 100_000, 4096
#: Mean recall that the number of cells read is chosen for, and the queries and results it is measured on.
RECALL, TRIALS, TRIAL_K = 0.95, 64, 10
SEED = 42


@dataclass
class CellIndex:
    folder: str  # (did, vector of length 1) by cell
    did: T.StructField
    centers: np.ndarray  # cell x dimension, of length 1; at most MOST_CELLS rows
    probes: int
    recall: float  # mean over the trials, with that many cells


def _unit(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``key`` and the vector scaled to length 1; null vectors and those of length zero take no part."""
    v = F.col(vec).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return (df.select(key, v.alias("v"), length.alias("n")).filter(F.col("n") > 0)
            .select(key, F.transform("v", lambda x: x / F.col("n")).alias("v")))


def _first_hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """About the first ``n`` rows in the order of a hash of their key: the same on any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(SEED)), key).limit(n)


def _near_cells(df: DataFrame, centers: np.ndarray, n: int) -> DataFrame:
    """``df`` once for each of the ``n`` nearest cells of its vector ``v``: adds ``cell`` and ``place`` (1 = nearest)."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("place", T.IntegerType())])
    at = df.columns.index("v")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, -1)
            order = np.argsort(-(v @ centers.T), axis=1, kind="stable")[:, :n]
            rows = np.repeat(np.arange(len(v)), order.shape[1])
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(v)))],
                names=schema.names)

    return df.mapInArrow(run, schema)


def build(vectors: DataFrame, did: str = "vec_id", vec: str = "embedding", cells: int | None = None) -> CellIndex:
    """Index all ``vectors``; ``cells``: the square root of their number by default."""
    spark = vectors.sparkSession
    unit = _unit(vectors, did, vec)
    n = unit.count()
    if not n:
        raise ValueError("no vectors")
    cells = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
    sample = write_table(_first_hashed(unit, did, SAMPLE), "ivf-sample")
    if cells > 1:
        fitted = KMeans(k=cells, seed=SEED, maxIter=10, distanceMeasure="cosine").fit(sample.select(array_to_vector("v").alias("features")))
        centers = np.array(fitted.clusterCenters())
    else:
        centers = np.array(sample.select("v").limit(1).collect()[0])
    centers = centers / np.maximum(np.sqrt((centers * centers).sum(axis=1, keepdims=True)), 1e-300)
    folder = f"{scratch_dir(spark, 'ivf')}-{uuid.uuid4().hex}"
    # rebalance: a task writes whole cells, and a large cell is cut into several files
    (_near_cells(unit, centers, 1).select(did, "v", "cell").hint("rebalance", "cell")
     .write.partitionBy("cell").parquet(folder))
    index = CellIndex(folder, vectors.schema[did], centers, len(centers), 1.0)
    index.probes, index.recall = _probes(spark, index, sample, did)
    return index


def _probes(spark, index: CellIndex, sample: DataFrame, did: str) -> tuple[int, float]:
    """The fewest cells whose mean recall over the trial queries is RECALL, from the exact results and the place of
    their cells in each query's order.  The trials' results (TRIALS x TRIAL_K rows) come to the driver."""
    trials = _first_hashed(sample, did, TRIALS).select(F.col(did).alias("_q"), "v")
    stored = spark.read.parquet(index.folder)
    exact = cosine_topk(trials, stored.select(did, "v"), TRIAL_K, "_q", did, "v")
    found = exact.join(stored.select(did, "cell"), did)
    order = _near_cells(trials, index.centers, len(index.centers)).select("_q", "cell", "place")
    places = np.array([r[0] for r in found.join(order, ["_q", "cell"]).select("place").collect()])
    share = np.array([(places <= p).mean() for p in range(1, len(index.centers) + 1)])
    probes = int(np.argmax(share >= RECALL)) + 1
    return probes, float(share[probes - 1])


def search(index: CellIndex, queries: DataFrame, k: int = K.RETRIEVAL_TOP_K, qid: str = "label", vec: str = "embedding",
           probes: int | None = None) -> DataFrame:
    """(qid, rank, did, score) by cosine among the vectors of each query's nearest cells; only those cells are read.
    A null query vector, or one of length zero, has no results."""
    spark = queries.sparkSession
    did = index.did.name
    asked = _near_cells(_unit(queries, qid, vec), index.centers, probes or index.probes).select(qid, "v", F.col("cell").alias("block"))
    schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(did, index.did.dataType),
                           T.StructField("score", T.DoubleType())])
    folder = f"{scratch_dir(spark, 'query-blocks')}-{uuid.uuid4().hex}"
    asked.repartition("block").write.partitionBy("block").parquet(folder)
    # cell numbers only, at most MOST_CELLS
    near = [r[0] for r in spark.read.schema(asked.schema).parquet(folder).select("block").distinct().collect()]
    corpus = spark.read.parquet(index.folder).filter(F.col("cell").isin(near)).select(did, "v", "cell")
    types, names, limit, cells = [to_arrow_type(f.dataType) for f in schema.fields], schema.names, B.SLAB_BYTES, B.CELLS

    def run(batches):
        for slab in B.slabs(batches, limit):
            of = np.asarray(slab.column("cell"))
            for cell in np.unique(of):
                docs = slab.filter(pa.array(of == cell))
                block = B.read_block(folder, int(cell))
                # a block of queries is taken a part at a time
                width = len(docs.column("v")[0])
                for first in range(0, block.num_rows, max(1, cells // width)):
                    part = block.slice(first, max(1, cells // width))
                    ids, q = part.column(qid).to_pylist(), B.listed(part, "v").reshape(part.num_rows, -1)
                    best = B.Best(len(ids), k)
                    step = B.step_for(width, len(ids))
                    for at in range(0, docs.num_rows, step):
                        some = docs.slice(at, step)
                        best.add(B.listed(some, "v").reshape(some.num_rows, -1) @ q.T, np.asarray(some.column(did).to_pylist()))
                    n, _, scores, found = best.rows
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in n.tolist()], types[0]), pa.array(found.tolist(), types[1]),
                                                      pa.array(scores, types[2])], names=names)

    best = corpus.mapInArrow(run, schema)
    w = Window.partitionBy(qid).orderBy(F.desc(F.round("score", B.RANK_DIGITS)), F.asc(did))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(qid, "rank", did, "score")
