"""Inverted-file search: recall against the exact search, only the probed cells read, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from wardlake.operators import blocks, ivf
from wardlake.operators import retrieval as RT
from wardlake.plans import retrieval_queries as Q
from wardlake.sources.tables import table


@pytest.fixture(scope="module")
def emb(spark):
    return table(spark, SF_MID, "embeddings")


@pytest.fixture(scope="module")
def index(emb):
    return ivf.build(emb)


def pairs(df, qid="label"):
    return {(r[qid], r["vec_id"]) for r in df.collect()}


def test_recall_of_held_queries(emb, index):
    asked = emb.filter("vec_id % 7 = 0").select((F.col("vec_id") + 10**6).alias("label"), "embedding")
    exact, near = (pairs(f) for f in (RT.cosine_topk(asked, emb, 10), ivf.search(index, asked, 10)))
    assert len(exact & near) >= 0.9 * len(exact)
    assert 1 <= index.probes < len(index.centers) and index.recall >= ivf.RECALL


def test_all_cells_give_the_exact_answer(emb, index, monkeypatch):
    asked = emb.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("label"), "embedding")
    exact = sorted((r["label"], r["rank"], r["vec_id"]) for r in RT.cosine_topk(asked, emb, 4).collect())
    every = ivf.search(index, asked, 4, probes=len(index.centers))
    assert sorted((r["label"], r["rank"], r["vec_id"]) for r in every.collect()) == exact
    monkeypatch.setattr(blocks, "CELLS", 128)
    monkeypatch.setattr(blocks, "SLAB_BYTES", 2000)
    small = ivf.search(index, asked, 4, probes=len(index.centers))
    assert sorted((r["label"], r["rank"], r["vec_id"]) for r in small.collect()) == exact


def test_only_probed_cells_are_read(spark, emb, index):
    one = emb.filter("vec_id = 0").select("label", "embedding")
    found = ivf.search(index, one, 3, probes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]
    cell = spark.read.parquet(index.folder).filter("vec_id = 0").first()["cell"]
    mine = {r["vec_id"] for r in spark.read.parquet(index.folder).filter(F.col("cell") == cell).collect()}
    assert {r["vec_id"] for r in found.collect()} <= mine


def test_odd_vectors(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)] + [(90, None), (91, [0.0, 0.0])] + [(100 + i, [1.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ix = ivf.build(df, cells=4)
    assert spark.read.parquet(ix.folder).count() == 60
    asked = spark.createDataFrame([(1, [5.0, 0.0]), (2, None), (3, [0.0, 0.0])], "label long, embedding array<double>")
    assert [(r["label"], r["vec_id"]) for r in ivf.search(ix, asked, 3).orderBy("rank").collect()] == [(1, 0), (1, 100), (1, 101)]
    assert ivf.search(ix, asked.filter("label = 2"), 3).count() == 0
    with pytest.raises(ValueError):
        ivf.build(df.filter("vec_id = 90"))


def test_query_keeps_most_of_the_exact_rows(spark, emb):
    got = Q.near_vectors(spark, SF_MID)
    asked = emb.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["vec_id"]) for r in RT.cosine_topk(asked, emb, 10, qid="query_id").collect()}
    assert len(exact & pairs(got, "query_id")) >= 0.9 * len(exact) and got.count() == len(exact)
