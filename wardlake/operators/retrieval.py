"""Guideline retrieval (J1-J5, A7, G-1, C7, C9, E1, E2).

All three searches score a *batch* of queries against a corpus and keep the
top k documents per query.  Ranking ties fall to the lower document id (the
corpus order).  Scores are ranked after rounding to 1e-9 so that exact
duplicates, whose float sums may differ in the last bit depending on
summation order, keep the corpus order.

Documents stay where they are: query blocks of bounded size, a table in the shared folder, are
read and scored inside each document's partition (``blocks.top_k``).  No (query, document)
pair and no token is shuffled; only k rows per query and slab of documents reach the exchange.

* ``overlap_topk``: size of the intersection of distinct whitespace tokens.
* ``tfidf_topk``: TF-IDF cosine where, as in the original service, the query
  itself is one more document of the corpus when the IDF is fitted.  Only
  the query's own terms change weight, so each document's base norm is
  computed once and adjusted per (query, doc) by the query terms it holds.
  Documents with score 0 still fill the top k (in corpus order).
* ``cosine_topk``: exact cosine over embedding vectors.

Query ids and document ids are unique; null and blank texts have no tokens; vectors
are all of one length.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake import constants as K
from wardlake.functions.text import whitespace_tokens, word_tokens
from wardlake.operators.blocks import RANK_DIGITS, SLAB_BYTES, cells_of, dense, listed, opened, slabs, step_for, term_matrix, top_k
from wardlake.session import ensure_checkpoint_dir, write_table
from wardlake.sources.tables import spread


def _rank(df: DataFrame, qid: str, did: str, k: int) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.desc(F.round("score", RANK_DIGITS)), F.asc(did))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- J1 -----------------------------------------------------------------------------

def _overlap_scorer(block: pa.Table):
    vocabulary, term, query = cells_of(block, "terms")
    weights = dense((term, query, 1.0), (len(vocabulary), block.num_rows))

    def score(part):
        shared = term_matrix(part.column(1), vocabulary) @ weights
        return np.where(shared > 0, shared, -np.inf)
    return step_for(len(vocabulary), block.num_rows), score


def overlap_topk(queries: DataFrame, corpus: DataFrame, k: int = K.OVERLAP_TOP_K, qid: str = "item_id",
                 did: str = "doc_id", text: str = "text") -> DataFrame:
    """(qid, rank, did, score): top k documents per query with score > 0."""
    asked = queries.select(qid, whitespace_tokens(F.col(text)).alias("terms")).filter(F.size("terms") > 0)
    docs = spread(corpus.select(did, text)).select(did, whitespace_tokens(F.col(text)).alias("terms"))
    best = top_k(docs, asked, qid, did, k, "terms", _overlap_scorer)
    return _rank(best, qid, did, k).select(qid, "rank", did, F.col("score").cast("long").alias("score"))


def kb_overlap(text: Column, sentences: list[str] = K.KB_SENTENCES, k: int = K.OVERLAP_TOP_K) -> Column:
    """J1 against a small fixed list of sentences, per row: the top k
    sentences (score > 0, ties in list order) joined with ' | '.

    Scores are sums of ``array_contains`` over each sentence's distinct
    tokens; the (-score, position) structs are sorted with ``sort_array``
    (unmatched ones are NULL and sort first) and the best k are picked by
    position: all codegen'd array functions, no per-element lambdas.
    """
    q = whitespace_tokens(text)
    entries = []
    for i, s in enumerate(sentences):
        score = F.lit(0)
        for t in sorted(set(s.lower().split())):
            score = score + F.array_contains(q, F.lit(t)).cast("int")
        entries.append((score, F.when(score > 0, F.struct((-score).alias("neg"), F.lit(i).alias("i"),
                                                          F.lit(s).alias("s")))))
    ranked = F.sort_array(F.array(*[e for _, e in entries]))
    skipped = F.lit(0)
    for score, _ in entries:
        skipped = skipped + (score == 0).cast("int")
    picks = [F.try_element_at(ranked, skipped + j)["s"] for j in range(1, k + 1)]
    return F.concat_ws(" | ", *picks)


# --- J2 -----------------------------------------------------------------------------

@dataclass
class TfidfIndex:
    """The query-independent half of TF-IDF search over one corpus, written as Parquet
    in the shared checkpoint dir and searched by any number of query batches."""

    corpus: DataFrame
    did: str
    n_docs: int
    docs: DataFrame      # (did, terms, tfs, n0): one row per document, n0 its base squared norm
    dfreq: DataFrame     # (term, df)


def _count_terms(batches):
    """(did, tokens) -> (did, distinct terms, their counts), whole batches at a time."""
    for batch in batches:
        tokens = batch.column(1)
        flat = tokens.flatten().dictionary_encode()
        words = max(len(flat.dictionary), 1)
        row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
        cell, counts = np.unique(row * words + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = pa.array(np.searchsorted(cell, np.arange(len(tokens) + 1) * words), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(ends, flat.dictionary.take(pa.array(cell % words))),
             pa.ListArray.from_arrays(ends, pa.array(counts, pa.float64()))], names=["did", "terms", "tfs"])


def _term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    counted = df.select(F.col(key).alias("did"), word_tokens(F.col(text)).alias("tokens")).mapInArrow(
        _count_terms, f"did {kind}, terms array<string>, tfs array<double>")
    return counted.withColumnRenamed("did", key)


def build_tfidf_index(corpus: DataFrame, did: str = "doc_id", text: str = "text") -> TfidfIndex:
    counted = write_table(_term_counts(spread(corpus.select(did, text)), did, text), "tfidf-counts")
    return _index_of(counted, write_table(_document_frequency(counted), "tfidf-df"), did)


def _document_frequency(counted: DataFrame) -> DataFrame:
    return (counted.select(F.explode("terms").alias("term")).groupBy("term")
            .agg(F.count(F.lit(1)).cast("double").alias("df")))


def _index_of(counted: DataFrame, dfreq: DataFrame, did: str) -> TfidfIndex:
    """The index from each document's term counts and the document frequencies (both written)."""
    # Corpus size: one count action (served from Parquet metadata), used as a literal.
    n = counted.count()
    docs = write_table(_with_norms(counted.filter(F.col(did).isNotNull() & (F.size("terms") > 0)), dfreq, n), "tfidf-docs")
    # rows that repeat an id share one norm, that of all their terms
    again = write_table(docs.groupBy(did).agg(F.count(F.lit(1)).alias("rows"), F.sum("n0").alias("whole")).filter("rows > 1").drop("rows"),
                        "tfidf-again")
    if not again.isEmpty():
        docs = docs.join(again, did, "left").withColumn("n0", F.coalesce("whole", "n0")).drop("whole")
    return TfidfIndex(counted, did, n, docs, dfreq)


def _frequencies(files: list[str]):
    """The written (term, df) rows, read by a task a piece at a time."""
    import pyarrow.dataset as ds

    for uri in files:
        system, path = opened(uri)
        for piece in ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=["term", "df"], batch_size=1 << 20):
            if piece.num_rows:
                yield piece.column(0), piece.column(1).to_numpy()


def _with_norms(counted: DataFrame, dfreq: DataFrame, n: int) -> DataFrame:
    """``counted`` (id, terms, tfs) plus ``n0``, the base squared norm of every document (IDF fitted without
    any query term).  No term is shuffled: for each slab of documents a task passes the written frequencies
    once and keeps those of the slab's own terms."""
    files, limit = dfreq.inputFiles(), SLAB_BYTES
    schema = T.StructType([*counted.schema.fields, T.StructField("n0", T.DoubleType())])

    def run(batches):
        for slab in slabs(batches, limit):
            parts = slab.to_batches()
            coded = pa.concat_arrays([p.column(1).flatten() for p in parts]).dictionary_encode()
            df = np.zeros(len(coded.dictionary))
            for terms, found in _frequencies(files):
                at = pc.fill_null(pc.index_in(terms, value_set=coded.dictionary), -1).to_numpy()
                df[at[at >= 0]] = found[at >= 0]
            weight = (np.log((n + 2) / (1 + df)) + 1)[coded.indices.to_numpy()] * np.concatenate([p.column(2).flatten().to_numpy() for p in parts])
            sizes = np.concatenate([p.column(1).value_lengths().to_numpy() for p in parts])
            n0 = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weight * weight, len(sizes))
            begin = 0
            for p in parts:
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(n0[begin:begin + p.num_rows])], names=schema.names)
                begin += p.num_rows

    return counted.mapInArrow(run, schema)


class SegmentedTfidf:
    """A TF-IDF index that grows (A7, D28): immutable segments under ``folder``, each with the term counts of
    its documents and their document frequencies.

    ``add`` tokenises and writes only documents whose id no segment holds, so adding a batch again adds nothing; which
    these are is found from the ids alone.  A segment counts once both its tables are written.  ``index`` merges the segments'
    frequencies and derives the norms, which every new document changes, from the counts: no text is read.
    One writer at a time.
    """

    def __init__(self, spark, folder: str, did: str = "doc_id", text: str = "text", kind: str = "bigint"):
        self.spark, self.folder, self.did, self.text, self.kind = spark, folder, did, text, kind
        self.segments: list[str] = []

    def _counts(self, names: list[str]) -> DataFrame:
        schema = f"{self.did} {self.kind}, terms array<string>, tfs array<double>"
        paths = [f"{self.folder}/counts/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, batch: DataFrame) -> None:
        new = batch.select(self.did, self.text).filter(F.col(self.did).isNotNull())
        ids = new.select(self.did)
        if self.segments:
            ids = ids.join(self._counts(self.segments).select(self.did), self.did, "left_anti")
        ids = write_table(ids.groupBy(self.did).agg(F.count(F.lit(1)).alias("rows")), "tfidf-new")
        fresh, rows = ids.agg(F.count(F.lit(1)), F.sum("rows")).first()
        if not fresh:
            return
        if rows < new.count():
            new = new.join(ids.select(self.did), self.did, "left_semi")
        if fresh < rows:
            new = new.dropDuplicates([self.did])
        name = uuid.uuid4().hex
        _term_counts(spread(new), self.did, self.text).write.parquet(f"{self.folder}/counts/{name}")
        _document_frequency(self._counts([name])).write.parquet(f"{self.folder}/terms/{name}")
        self.segments.append(name)

    def index(self) -> TfidfIndex:
        terms = self.spark.read.schema("term string, df double").parquet(*[f"{self.folder}/terms/{n}" for n in self.segments])
        merged = write_table(terms.groupBy("term").agg(F.sum("df").alias("df")), "tfidf-df")
        return _index_of(self._counts(self.segments), merged, self.did)


def _tfidf_scorer(block: pa.Table):
    vocabulary, term, query = cells_of(block, "terms")
    weights, shifts = (dense((term, query, listed(block, c)), (len(vocabulary), block.num_rows)) for c in ("weights", "shifts"))
    norms = np.sqrt(np.asarray(block.column("qn")))

    def score(part):
        tf = term_matrix(part.column(1), vocabulary, part.column(2).flatten().to_numpy())
        dot = tf @ weights
        size = part.column(3).to_numpy()[:, None] + (tf * tf) @ shifts
        return np.where(dot > 0, dot / (norms * np.sqrt(np.where(dot > 0, size, 1.0))), -np.inf)
    return step_for(len(vocabulary), len(norms)), score


def tfidf_search(index: TfidfIndex, queries: DataFrame, k: int = K.RETRIEVAL_TOP_K, qid: str = "item_id",
                 text: str = "text") -> DataFrame:
    """(qid, rank, did, score) with exact smooth-IDF, L2-normalised cosine,
    the query counted as one more document when the IDF is fitted."""
    did = index.did
    n2 = F.lit(float(index.n_docs + 2))
    idf0 = F.log(n2 / (1 + F.col("df"))) + 1
    q_terms = (_term_counts(queries, qid, text).select(qid, F.explode(F.arrays_zip("terms", "tfs")).alias("c"))
               .select(qid, F.col("c.terms").alias("term"), F.col("c.tfs").alias("tfq")))
    idfq = F.log(n2 / (2 + F.coalesce(F.col("df"), F.lit(0.0)))) + 1
    # A query is one text: its term list is bounded by it.
    known = lambda c: F.collect_list(F.when(F.col("df").isNotNull(), c))
    asked = (q_terms.join(index.dfreq, "term", "left")
             .select(qid, "term", "df", (F.col("tfq") * idfq * idfq).alias("w"),
                     (idfq * idfq - F.coalesce(idf0, F.lit(0.0)) * F.coalesce(idf0, F.lit(0.0))).alias("s"), "tfq")
             .groupBy(qid).agg(known(F.struct("term", "w", "s")).alias("t"), F.sum(F.col("tfq") * F.col("w")).alias("qn"))
             .filter(F.size("t") > 0)
             .select(qid, F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), F.col("t.s").alias("shifts"), "qn"))
    docs = index.docs.select(did, "terms", "tfs", "n0")
    scored = top_k(docs, asked, qid, did, k, "terms", _tfidf_scorer)
    best = _rank(scored, qid, did, k).select(qid, did, "score")

    # Zero-score fill: the first k documents in corpus order, for every query.
    first_docs = [r[0] for r in index.corpus.select(did).orderBy(did).limit(k).collect()]
    fill = queries.select(qid, F.explode(F.array(*[F.lit(d) for d in first_docs])).alias(did),
                          F.lit(0.0).alias("score")) if first_docs else None
    cand = best if fill is None else best.unionByName(fill)
    cand = cand.groupBy(qid, did).agg(F.max("score").alias("score"))
    return _rank(cand, qid, did, k).select(qid, "rank", did, "score")


def tfidf_topk(queries: DataFrame, corpus: DataFrame, k: int = K.RETRIEVAL_TOP_K, qid: str = "item_id",
               did: str = "doc_id", text: str = "text", index: TfidfIndex | None = None) -> DataFrame:
    """Build (or reuse) the corpus index and search it with ``queries``."""
    index = index or build_tfidf_index(corpus, did, text)
    return tfidf_search(index, queries, k, qid, text)


# --- J3 -----------------------------------------------------------------------------

def centroids(vectors: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per key: explode positions, average, reassemble in order."""
    per_dim = (vectors.select(key, F.posexplode(vec).alias("pos", "x"))
               .groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x")))
    return (per_dim.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("dims"))
            .select(key, F.transform("dims", lambda d: d["x"]).alias(vec)))


def _vector_scorer(vec: str):
    def scorer(block: pa.Table):
        queries = listed(block, vec).reshape(block.num_rows, -1)
        lengths = np.sqrt((queries * queries).sum(axis=1))

        def score(part):
            docs = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            size = np.sqrt((docs * docs).sum(axis=1))[:, None] * lengths
            return np.where(size > 0, (docs @ queries.T) / np.where(size > 0, size, 1.0), 0.0)
        return step_for(*queries.shape), score
    return scorer


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = K.RETRIEVAL_TOP_K, qid: str = "label",
                did: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(qid, rank, did, score) by exact cosine similarity, n = min(k, corpus size).
    A null vector takes no part; one of length zero scores 0."""
    as_double = F.col(vec).cast("array<double>").alias(vec)
    asked = queries.select(qid, as_double).filter(F.col(vec).isNotNull())
    docs = corpus.select(did, as_double).filter(F.col(vec).isNotNull())
    best = top_k(docs, asked, qid, did, k, vec, _vector_scorer(vec), shared_width=True)
    return _rank(best, qid, did, k).select(qid, "rank", did, "score")


# --- J4 / J5 / A7 --------------------------------------------------------------------

def retrieve_with_fallback(queries: DataFrame, methods, qid: str = "item_id") -> DataFrame:
    """Per query, the results of the first method (in the order given)
    that returns anything for it; adds a ``method`` column.

    ``methods`` is a list of (name, fn) with fn(queries) -> ranked results.
    Each method only receives the queries that the previous ones left
    unanswered; when none are left, AQE sees the empty query side at run
    time and drops the corpus side of that join entirely.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    out, pending = None, queries
    for name, fn in methods:
        # at most k rows per query: materialised once, then both returned and
        # used to find the queries still unanswered
        res = fn(pending).withColumn("method", F.lit(name)).checkpoint(eager=True)
        out = res if out is None else out.unionByName(res)
        pending = pending.join(res.select(qid).distinct(), qid, "left_anti")
    return out


def case_query(symptoms: Column, history: Column) -> Column:
    """The text that a case is searched by: its listed symptoms and history, joined by blanks."""
    parts = lambda c: F.split(F.coalesce(c, F.lit("")), ", ", -1)
    return F.concat_ws(" ", parts(symptoms), parts(history))


def explanations(results: DataFrame, docs: DataFrame, qid: str, did: str = "doc_id",
                 chars: int = K.RETRIEVAL_TEXT_CHARS) -> DataFrame:
    """J5: 'From {source}: {text}' joined in rank order per query."""
    return guidelines(results, docs, qid, did, chars).select(qid, "explanation")


def guidelines(results: DataFrame, docs: DataFrame, qid: str, did: str = "doc_id", chars: int = K.RETRIEVAL_TEXT_CHARS,
               snippet: int = K.RAG_SNIPPET_CHARS) -> DataFrame:
    """Per query, of its results in rank order: the ``explanation`` (J5), and ``context``, the first
    ``snippet`` characters of each text (B14)."""
    texts = docs.select(did, "source", F.substring("text", 1, chars).alias("long"), F.substring("text", 1, snippet).alias("short"))
    part = F.concat(F.lit("From "), F.col("source"), F.lit(": "), F.col("long"))
    # at most k results a query; written, so that few of them join by their measured size without moving the texts
    results = write_table(results.select(qid, "rank", did), "retrieved")
    agg = (results.join(texts, did).groupBy(qid)
           .agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p"), "short"))).alias("parts")))
    return agg.select(qid, F.array_join(F.transform("parts", lambda x: x["p"]), " ").alias("explanation"),
                      F.array_join(F.transform("parts", lambda x: x["short"]), " | ").alias("context"))


def new_documents(batch: DataFrame, index: DataFrame, key: str = "source", order: str = "doc_id") -> DataFrame:
    """Rows of ``batch`` whose key is not yet in ``index``; one row per
    new key (the first in ``order``), so appending is idempotent."""
    new = batch.join(index.select(key).distinct(), key, "left_anti")
    rest = [c for c in new.columns if c not in (key, order)]
    first = new.groupBy(key).agg(F.min(F.struct(*dict.fromkeys([order] + rest))).alias("f"))
    return first.select(key, *[F.col(f"f.{c}").alias(c) for c in dict.fromkeys([order] + rest) if c != key])
