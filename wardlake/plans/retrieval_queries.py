"""Retrieval queries: every benchmark item is a query against the whole
document corpus; label centroids are vector queries against all embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions.text import sql_whitespace_tokens, sql_word_tokens
from wardlake.operators import ivf
from wardlake.operators import retrieval as RT
from wardlake.plans.registry import register
from wardlake.session import scratch_dir, write_table
from wardlake.sources.tables import data_version, table

K3 = K.RETRIEVAL_TOP_K

_INDEXES: dict = {}


def corpus_index(spark, sf) -> RT.TfidfIndex:
    """The TF-IDF index of the document corpus, built once per session and state
    of the files and searched by every TF-IDF query (as the guideline index is
    built once and queried per request)."""
    docs = table(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, sf, data_version(docs))
    if key not in _INDEXES:
        _INDEXES[key] = RT.build_tfidf_index(docs)
    return _INDEXES[key]


def _overlap_sql() -> tuple[str, dict]:
    return (f"""SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ov) x
        WHERE rank <= {K.OVERLAP_TOP_K}""", {
        "qtok": f"SELECT item_id, unnest({sql_whitespace_tokens('text')}) AS token FROM benchmark",
        "dtok": f"SELECT doc_id, unnest({sql_whitespace_tokens('text')}) AS token FROM documents",
        "ov": "SELECT item_id, doc_id, count(*) AS score FROM qtok JOIN dtok USING (token) GROUP BY 1, 2",
    })


@register("overlap_top3", _overlap_sql)
def overlap_top3(spark, sf):
    return RT.overlap_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), K.OVERLAP_TOP_K)


def tfidf_ctes(query_sql: str, qid: str, k: int = K3) -> dict[str, str]:
    """SQL form of tfidf_topk for queries given as SELECT {qid}, text."""
    return {
        "t_dt": f"""SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM (
            SELECT doc_id, unnest({sql_word_tokens('text')}) AS term FROM documents) x GROUP BY 1, 2""",
        "t_n": "SELECT CAST(count(*) AS DOUBLE) + 2 AS n2 FROM documents",
        "t_df": "SELECT term, CAST(count(*) AS DOUBLE) AS df FROM t_dt GROUP BY term",
        "t_dn": """SELECT doc_id, sum(tf * tf * pow(ln(n2 / (1 + df)) + 1, 2)) AS n0
            FROM t_dt JOIN t_df USING (term) CROSS JOIN t_n GROUP BY doc_id""",
        "t_q": query_sql,
        "t_qt": f"""SELECT {qid}, term, CAST(count(*) AS DOUBLE) AS tfq FROM (
            SELECT {qid}, unnest({sql_word_tokens('text')}) AS term FROM t_q) x GROUP BY 1, 2""",
        "t_qx": f"""SELECT {qid}, term, tfq, ln(n2 / (2 + coalesce(df, 0))) + 1 AS idfq,
            CASE WHEN df IS NOT NULL THEN ln(n2 / (1 + df)) + 1 END AS idf0
            FROM t_qt LEFT JOIN t_df USING (term) CROSS JOIN t_n""",
        "t_qn": f"SELECT {qid}, sum(tfq * tfq * idfq * idfq) AS qn FROM t_qx GROUP BY 1",
        "t_pr": f"""SELECT {qid}, doc_id, sum(tfq * tf * idfq * idfq) AS dot,
            sum(tf * tf * (idfq * idfq - idf0 * idf0)) AS delta
            FROM t_qx JOIN t_dt USING (term) WHERE idf0 IS NOT NULL GROUP BY 1, 2""",
        "t_sc": f"""SELECT {qid}, doc_id, dot / (sqrt(qn) * sqrt(n0 + delta)) AS score
            FROM t_pr JOIN t_qn USING ({qid}) JOIN t_dn USING (doc_id)""",
        "t_fill": f"""SELECT q.{qid}, d.doc_id, 0.0::DOUBLE AS score FROM (SELECT DISTINCT {qid} FROM t_q) q
            CROSS JOIN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {k}) d""",
        "t_rank": f"""SELECT {qid}, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY round(score, {RT.RANK_DIGITS}) DESC, doc_id) AS rank
            FROM (SELECT {qid}, doc_id, max(score) AS score FROM (
                SELECT * FROM t_sc UNION ALL SELECT * FROM t_fill) u GROUP BY 1, 2) c) r WHERE rank <= {k}""",
    }


@register("tfidf_topk", lambda: ("SELECT item_id, rank, doc_id, round(score, 3) AS score FROM t_rank",
                                 tfidf_ctes("SELECT item_id, text FROM benchmark", "item_id")))
def tfidf_topk(spark, sf):
    r = RT.tfidf_search(corpus_index(spark, sf), table(spark, sf, "benchmark"), K3)
    return r.select("item_id", "rank", "doc_id", F.round("score", 3).alias("score"))


#: Documents arrive in this many batches, dealt by id.
ARRIVALS = 3


@register("tfidf_segments", lambda: ("SELECT item_id, rank, doc_id, round(score, 3) AS score FROM t_rank",
                                     tfidf_ctes("SELECT item_id, text FROM benchmark", "item_id")))
def tfidf_segments(spark, sf):
    """All documents, arriving in batches, one of them twice, are indexed segment by segment; the
    search gives what an index built at once gives."""
    docs = table(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, sf, "segments", data_version(docs))
    if key not in _INDEXES:
        grown = RT.SegmentedTfidf(spark, f"{scratch_dir(spark, 'tfidf-segments')}-{uuid.uuid4().hex}")
        for i in [*range(ARRIVALS), 0]:
            grown.add(docs.filter(F.pmod("doc_id", F.lit(ARRIVALS)) == i))
        _INDEXES[key] = grown.index()
    r = RT.tfidf_search(_INDEXES[key], table(spark, sf, "benchmark"), K3)
    return r.select("item_id", "rank", "doc_id", F.round("score", 3).alias("score"))


#: The view behind ``retrieve_fallback``: an item's vector is the embedding numbered
#: 25 times its id, where there is one; a document's is the embedding of its id.
ITEM_VECTOR_STEP = 25


def _fallback_sql() -> tuple[str, dict]:
    return ("""SELECT item_id, rank, doc_id, round(score, 3) AS score, 'vector' AS method FROM v_rank
        UNION ALL SELECT item_id, rank, doc_id, round(score, 3) AS score, 'tfidf' AS method FROM t_rank
        WHERE item_id NOT IN (SELECT item_id FROM v_rank)""", {
        **tfidf_ctes("SELECT item_id, text FROM benchmark", "item_id"),
        "v_q": f"""SELECT item_id, CAST(embedding AS DOUBLE[]) AS qv FROM benchmark
            JOIN embeddings ON vec_id = item_id * {ITEM_VECTOR_STEP}""",
        "v_d": "SELECT doc_id, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON vec_id = doc_id",
        "v_s": """SELECT item_id, doc_id, list_dot_product(qv, v)
            / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))) AS score FROM v_q CROSS JOIN v_d""",
        "v_rank": f"""SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, {RT.RANK_DIGITS}) DESC, doc_id) AS rank
            FROM v_s) x WHERE rank <= {K3}"""})


@register("retrieve_fallback", _fallback_sql)
def retrieve_fallback(spark, sf):
    """Per query: vector results if it has an embedding, else TF-IDF, else token overlap."""
    q, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = q.join(vectors, vectors["vec_id"] == q["item_id"] * ITEM_VECTOR_STEP, "left").select("item_id", "text", "embedding")
    doc_vectors = d.select("doc_id").join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    idx = corpus_index(spark, sf)
    r = RT.retrieve_with_fallback(q, [
        ("vector", lambda qs: RT.cosine_topk(qs, doc_vectors, K3, "item_id", "doc_id")),
        ("tfidf", lambda qs: RT.tfidf_search(idx, qs, K3)),
        ("overlap", lambda qs: RT.overlap_topk(qs, d, K3).withColumn("score", F.col("score").cast("double")))])
    return r.select("item_id", "rank", "doc_id", F.round("score", 3).alias("score"), "method")


def _explained_ctes() -> dict[str, str]:
    return {
        "rq": """SELECT case_id, array_to_string(list_concat(string_split(coalesce(symptoms, ''), ', '),
                   string_split(coalesce(history, ''), ', ')), ' ') AS query FROM cases_v""",
        **tfidf_ctes("SELECT DISTINCT query, query AS text FROM rq", "query"),
        "explained": f"""SELECT q.query, coalesce(e.explanation, '{K.NO_GUIDELINE}') AS explanation
            FROM (SELECT DISTINCT query FROM rq) q LEFT JOIN (
              SELECT query, string_agg('From ' || d.source || ': ' || substr(d.text, 1, {K.RETRIEVAL_TEXT_CHARS}), ' '
                ORDER BY rank) AS explanation FROM t_rank JOIN documents d USING (doc_id) GROUP BY query) e USING (query)"""}


def _case_queries(spark, sf):
    from wardlake.sources import fixtures as V
    return V.cases_v(spark, sf).select("case_id", RT.case_query(F.col("symptoms"), F.col("history")).alias("query"))


def guideline_ctes() -> dict[str, str]:
    """``rq`` (case_id, query) and ``guidelines`` (query, explanation, context)."""
    return {**_explained_ctes(), "guidelines": f"""SELECT query, string_agg('From ' || d.source || ': ' || substr(d.text, 1, {K.RETRIEVAL_TEXT_CHARS}), ' '
        ORDER BY rank) AS explanation, string_agg(substr(d.text, 1, {K.RAG_SNIPPET_CHARS}), ' | ' ORDER BY rank) AS context
        FROM t_rank JOIN documents d USING (doc_id) GROUP BY query"""}


def case_guidelines(spark, sf):
    """(query, rag_explanation, context) of every distinct case text: each is searched once.  Written: cases join
    them by their measured size."""
    qs = write_table(_case_queries(spark, sf).select("query").distinct(), "case-queries")
    res = RT.tfidf_search(corpus_index(spark, sf), qs.withColumn("text", F.col("query")), K3, qid="query")
    found = RT.guidelines(res, table(spark, sf, "documents"), "query").withColumnRenamed("explanation", "rag_explanation")
    return write_table(found, "case-guidelines")


@register("rag_explanations", lambda: ("SELECT query, explanation FROM explained", _explained_ctes()))
def rag_explanations(spark, sf):
    """One explanation per distinct case query text (symptoms + history)."""
    qs = write_table(_case_queries(spark, sf).select("query").distinct(), "case-queries")
    docs = table(spark, sf, "documents")
    res = RT.tfidf_search(corpus_index(spark, sf), qs.withColumn("text", F.col("query")), K3, qid="query")
    ex = RT.explanations(res, docs, "query")
    return qs.join(ex, "query", "left").select(
        "query", F.coalesce("explanation", F.lit(K.NO_GUIDELINE)).alias("explanation"))


@register("case_explanations", lambda: ("SELECT case_id, explanation FROM rq JOIN explained USING (query)", _explained_ctes()))
def case_explanations(spark, sf):
    """J5 per case: each distinct query text is searched once and joined back to its cases."""
    explained = write_table(rag_explanations(spark, sf), "explained")
    return _case_queries(spark, sf).join(explained, "query").select("case_id", "explanation")


def _cos_sql() -> tuple[str, dict]:
    return (f"""SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 3) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, {RT.RANK_DIGITS}) DESC, vec_id) AS rank
        FROM cs) x WHERE rank <= {K3}""", {
        "cdim": """SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (
            SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e GROUP BY 1, 2""",
        "cent": "SELECT label, list(x ORDER BY i) AS qv FROM cdim GROUP BY label",
        "evec": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
        "cs": """SELECT c.label, e.vec_id, list_dot_product(c.qv, e.v)
                   / (sqrt(list_dot_product(c.qv, c.qv)) * sqrt(list_dot_product(e.v, e.v))) AS score
                 FROM cent c CROSS JOIN evec e""",
    })


@register("cosine_topk", _cos_sql)
def cosine_topk(spark, sf):
    """Top 3 vectors nearest (cosine) to each label's centroid, searched over
    the whole embedding table."""
    emb = table(spark, sf, "embeddings")
    r = RT.cosine_topk(RT.centroids(emb), emb, K3)
    return r.select("label", "rank", "vec_id", F.round("score", 3).alias("score"))


#: Queries of the approximate search: every vector whose id is divisible by this, against all.
SEARCHED, NEAR_K = 100, 10


def vector_index(spark, sf) -> ivf.CellIndex:
    """The cells of all embeddings, built once per session and state of the files."""
    emb = table(spark, sf, "embeddings")
    key = (spark.sparkContext.applicationId, sf, "cells", data_version(emb))
    if key not in _INDEXES:
        _INDEXES[key] = ivf.build(emb)
    return _INDEXES[key]


@register("near_vectors")
def near_vectors(spark, sf):
    """J3, approximate: the 10 nearest vectors by cosine among the cells next to each query.  Which cells is
    a matter of the fitted index, so there is no SQL twin; recall is tested against ``cosine_topk``."""
    asked = table(spark, sf, "embeddings").filter(F.col("vec_id") % SEARCHED == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    r = ivf.search(vector_index(spark, sf), asked, NEAR_K, qid="query_id")
    return r.select("query_id", "rank", "vec_id", F.round("score", 3).alias("score"))


@register("index_new_docs", """SELECT d.doc_id, d.source FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def index_new_docs(spark, sf):
    """Documents not yet in the index (the index holds the labelled
    documents); each document is its own indexed item, keyed by doc_id."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    index = table(spark, sf, "labels").select("doc_id")
    return RT.new_documents(docs, index, key="doc_id", order="doc_id").select("doc_id", "source")
