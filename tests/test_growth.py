"""Steps whose shuffles, driver traffic and memory must not outgrow the input."""

import math

import numpy as np
import pytest
from pyspark import RDD

from tests.conftest import SF_SMALL
from wardlake.operators import blocks as B
from wardlake.operators import boosting as BO
from wardlake.operators import retrieval as RT
from wardlake.plans import registry
from wardlake.sources import fixtures as V
from wardlake.sources import tables

registry.load_all()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_norms_without_shuffled_terms(spark, monkeypatch):
    monkeypatch.setattr(RT, "SLAB_BYTES", 1)
    texts = [(1, "aa aa bb"), (2, "bb cc"), (3, None), (4, "cc"), (4, "aa dd"), (None, "aa")]
    corpus = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    index = RT.build_tfidf_index(corpus)
    df = {"aa": 3, "bb": 2, "cc": 2, "dd": 1}
    idf = {t: math.log((len(texts) + 2) / (1 + n)) + 1 for t, n in df.items()}
    want = {1: 4 * idf["aa"] ** 2 + idf["bb"] ** 2, 2: idf["bb"] ** 2 + idf["cc"] ** 2, 4: idf["cc"] ** 2 + idf["aa"] ** 2 + idf["dd"] ** 2}
    found = [(r["doc_id"], r["n0"]) for r in index.docs.collect()]
    assert sorted(i for i, _ in found) == [1, 2, 4, 4]
    for i, n0 in found:
        assert n0 == pytest.approx(want[i], abs=1e-12)
    assert "Exchange" not in plan_of(RT._with_norms(index.corpus, index.dfreq, index.n_docs))


def test_cases_join_few_explanations_without_being_dealt_by_text(spark):
    assert "SortMergeJoin" not in plan_of(registry.QUERIES["case_explanations"](spark, SF_SMALL))


def test_a_known_batch_is_not_shuffled_by_text(spark, tmp_dir, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    grown = RT.SegmentedTfidf(spark, tmp_dir)
    read = []
    monkeypatch.setattr(RT, "_term_counts", lambda df, key, text, f=RT._term_counts: (read.append(plan_of(df)), f(df, key, text))[1])
    grown.add(docs.coalesce(1))
    grown.add(docs.coalesce(1))
    assert len(read) == 1 and "Aggregate" not in read[0] and "Join" not in read[0]


def _blocks(n, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 8, (n, 3)).astype(np.uint8), rng.integers(0, 3, n).astype(np.uint8), rng.normal(size=(n, 3))


def test_children_are_what_is_left_of_their_parents():
    s, parts = BO.Setting(bins=8, depth=2), [_blocks(200, i) for i in range(3)]
    root = BO._sums(parts, [], np.zeros(1, np.int64), s, 3)
    level = BO.best_splits(root, s)
    side = BO._lighter(root, *level, s)
    both = [BO._sums(parts, [level], np.array([i]), s, 3) for i in (0, 1)]
    assert both[side[0]][3:].sum() <= both[1 - side[0]][3:].sum()
    assert (BO._children(root, both[side[0]], side) == np.concatenate(both, axis=2)).all()


def test_sums_reach_the_driver_once_a_feature(spark, monkeypatch):
    s = BO.Setting(bins=8)
    parts = [_blocks(50, i) for i in range(12)]
    rows = spark.sparkContext.parallelize(parts, 12)
    sent = []

    def collected(rdd, f=RDD.collect):
        out = f(rdd)
        sent.append(len(out))
        return out

    monkeypatch.setattr(RDD, "collect", collected)
    zero = np.zeros(1, np.int64)
    assert (BO._added(rows, [], zero, s, 3) == BO._sums(parts, [], zero, s, 3)).all()
    assert sent == [3]


def test_best_keeps_only_what_may_stay():
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 9, (500, 7)).astype(float)
    scores[rng.random(scores.shape) < 0.1] = np.nan
    scores[scores == 0] = -np.inf
    ids = rng.permutation(500)
    best = B.Best(7, 3)
    for at in range(0, 500, 120):
        best.add(scores[at:at + 120], ids[at:at + 120])
    q, _, found, kept = best.rows
    for j in range(7):
        want = sorted((-scores[i, j], ids[i]) for i in range(500) if scores[i, j] > -np.inf)[:3]
        assert [(-s, i) for s, i in zip(found[q == j], kept[q == j], strict=True)] == want
    assert B.step_for(5000, 200) * 5000 <= B.STEP_CELLS < B.CELLS


def test_requests_are_dealt_in_more_parts_as_they_grow(spark, monkeypatch):
    n = tables.table(spark, SF_SMALL, "lineitem").count()
    monkeypatch.setattr(tables, "TASK_ROWS", n // 40)
    assert tables.parts_for(tables.table(spark, SF_SMALL, "lineitem")) >= 40
    plan = plan_of(V.requests_v(spark, SF_SMALL))
    assert "hashpartitioning(slot_id#" in plan and f", {math.ceil(n / (n // 40))}), REPARTITION_BY_NUM" in plan
