"""The growing TF-IDF index: a batch is tokenised once, and answers equal those of an index built at once."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardlake.operators import retrieval as RT
from wardlake.sources.tables import table


def answers(index, queries, k=4):
    return sorted((r["item_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in RT.tfidf_search(index, queries, k).collect())


def test_grown_index_equals_one_built_at_once(spark, tmp_dir):
    docs, queries = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark")
    grown = RT.SegmentedTfidf(spark, tmp_dir)
    cuts = [0, 30, 31, 120, 10**9]
    for a, b in zip(cuts, cuts[1:]):
        grown.add(docs.filter(F.col("doc_id").between(a, b - 1)))
        part = docs.filter(F.col("doc_id") < b)
        assert answers(grown.index(), queries) == answers(RT.build_tfidf_index(part), queries)
    assert len(grown.segments) == 4
    n = spark.read.parquet(f"{tmp_dir}/counts/*").count()
    grown.add(docs)  # all known
    grown.add(docs.limit(0))
    assert len(grown.segments) == 4 and spark.read.parquet(f"{tmp_dir}/counts/*").count() == n == docs.count()
    more = spark.createDataFrame([(5, "changed text is not read"), (900_001, "brand new words"), (900_001, "brand new words"), (None, "x")], "doc_id long, text string")
    grown.add(more)
    assert grown.index().n_docs == n + 1
    known = {r["term"] for r in grown.index().dfreq.collect()}
    assert {"brand", "new"} <= known


def test_no_segments(spark, tmp_dir):
    grown = RT.SegmentedTfidf(spark, tmp_dir)
    grown.add(spark.createDataFrame([], "doc_id long, text string"))
    assert grown.segments == []
    empty = grown.index()
    assert empty.n_docs == 0 and answers(empty, table(spark, SF_SMALL, "benchmark")) == []
