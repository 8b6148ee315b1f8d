"""Exact top-k search and hard-negative mining on odd rows, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardlake.llm import hard_negatives, top_k, vectors

SCHEMA = "vec_id long, label int, embedding array<float>, score long, cells string, rid string, rank int"
MOST = (1 << 63) - 1


def odd_vectors():
    rng = np.random.default_rng(7)
    near = rng.normal(size=8)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=8)]) for i in range(0, 330)]
    rows += [(1000 + i, 1, [float(x) for x in near]) for i in range(60)]  # copies, queries among them
    rows += [(1100 + i, i % 3, [float(x + rng.normal() / 400) for x in near]) for i in range(60)]  # near copies
    rows += [(i, l, v) for i, l, v in rows[:20]]  # repeated rows
    rows += [(50, 3, [1.0] * 8), (100, None, [2.0] * 8), (7, 2, [-1.0] * 8)]  # an id with another vector
    rows += [(2000, 1, None), (2050, 1, [1.0, None, 2.0]), (2100, 1, [float("nan")] * 8), (2150, 2, [float("inf"), 1.0]),
             (None, 1, [1.0] * 8), (2200, 2, []), (2250, 1, [3.0, 1.0]), (2300, 0, [0.5] * 11), (2350, 2, [0.0] * 8),
             (2400, 2, [0.0] * 8), (2401, 1, [0.0] * 8), (-50, 1, [0.25] * 8), (-7, 9, [0.5] * 8)]
    return [(*r, 1, "c", "r", 2) for r in rows]


def taking_part(rows, moved=None):
    out = set()
    for r in rows:
        i, label, v = r[:3]
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (moved and label is None):
            continue
        if moved:
            label = math.fmod(label + 1, 10) if i % moved == 0 else label
        cells = tuple(max(-MOST - 1, min(MOST, math.floor(256 * float(np.float32(x))))) for x in v)
        out.add((i, int(label) if moved else 0, cells))
    return sorted(out)


def score(a, b):
    return max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b, strict=False))))


def least(rows, every):
    out = {}
    for i, label, v in rows:
        if i % every == 0:
            out[i] = min(out.get(i, (label, v)), (label, v))
    return out


def brute_top_k(rows, every=50, k=5):
    rows, out = taking_part(rows), []
    for q, (_, v) in least(rows, every).items():
        best = sorted((-score(v, c), i) for i, _, c in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def brute_mine(rows, every=50):
    rows, out = taking_part(rows, hard_negatives.MOVED), []
    for a, (label, v) in least(rows, every).items():
        found = sorted((-score(v, c), i, lab) for i, lab, c in rows if i != a)
        for p, i in [(-s, i) for s, i, lab in found if lab == label][:5]:
            near = [(-s, j) for s, j, lab in found if lab != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, i, n, j, p, s) for n, (s, j) in enumerate(near, 1)]
    return sorted(out)


def listed(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_vectors(), SCHEMA)


@pytest.fixture(params=["whole", "small blocks"])
def blocks(request, monkeypatch):
    if request.param == "small blocks":
        for name, value in (("QUERY_VALUES", 40), ("BLOCK_ROWS", 100), ("LEAST_ROWS", 50), ("SCORES", 64)):
            monkeypatch.setattr(vectors, name, value)


def test_top_k_brute(odd, blocks):
    assert listed(top_k.digest(odd)) == brute_top_k(odd_vectors())


def test_top_k_reads_on_until_certain(odd, monkeypatch):
    monkeypatch.setattr(top_k, "BITS", 1)  # wide cells: many rounds of reading
    monkeypatch.setattr(top_k, "FIRST_READ", 1)
    assert listed(top_k.digest(odd)) == brute_top_k(odd_vectors())


def test_hard_negatives_brute(odd, blocks):
    expected = brute_mine(odd_vectors())
    assert len(expected) > 20
    assert listed(hard_negatives.digest(odd)) == expected


def test_huge_components(spark):
    rows = [(0, 1, [3e30, 1.0]), (50, 2, [-2e30, 5.0]), (1, 1, [1e10, 2.0]), (2, 2, [1e10, 1.0]), (3, 1, [5e7, 5e7]), (4, 2, [4e7, 5e7])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert listed(top_k.digest(df)) == brute_top_k(rows)
    assert listed(hard_negatives.digest(df)) == brute_mine(rows)


def test_few_rows_and_none(spark, odd):
    for rows in ([], [(50, 1, [1.0])], [(50, 1, [1.0]), (50, 1, [1.0])], [(1, 1, [1.0]), (50, 1, None)]):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        assert top_k.digest(df).count() == hard_negatives.digest(df).count() == 0
    assert top_k.digest(spark.createDataFrame([(50, 1, [1.0]), (3, 1, [2.0])], "vec_id long, label int, embedding array<float>")
                        ).collect() == [(50, 1, 3, 256 * 512)]
    assert [f.dataType.simpleString() for f in hard_negatives.digest(odd).schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_all_rows_alike(spark):
    df = spark.range(500).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"),
                                 F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    found = {r[0]: [] for r in df.filter("vec_id % 50 = 0").collect()}
    for q, _, i, s in listed(top_k.digest(df)):
        found[q].append((i, s))
    for q, got in found.items():
        assert got == [(i, 128 * 128 + 64 * 64) for i in range(6) if i != q][:5]


def test_top_k_codes_bound_scores(spark):
    """The codes' cells hold the components, so that bounds are bounds."""
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = vectors.smallest_ids(vectors.whole_vectors(df), 6).withColumn("rid", F.monotonically_increasing_id())
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    low, high = top_k.cell_ends(rows)
    for r, c in zip(rows.collect(), top_k.codes(rows, low).collect(), strict=True):
        code = np.frombuffer(c["codes"], np.uint8)
        at = np.arange(len(code))
        assert (low[at, code] <= r["cells"]).all() and (r["cells"] <= high[at, code]).all()
