"""Language identification by error-correcting output codes.

Each language has a codeword of bits; each bit splits the languages in two and has a
binary classifier, naive Bayes over hashed byte 2- and 3-grams.  A text's margins, one
per bit, are decoded to the language whose codeword has the least sum of logistic losses,
each weighted by how far apart its bit's two classes are.  The score is the softmax of
the negative losses; a text whose two best codewords are close is ambiguous.

Up to seven languages use the exhaustive code (all 2^(k-1) - 1 splits, so any two
codewords differ in 2^(k-2) bits); more use the best of some random codes.

Learning: n-gram counts per language over all given rows, summed in Spark; the driver
gets one vector per language and derives the weights.

Defined cases: a null text or one without a letter is ``und`` with score 0; without
learning rows every text is; with one language every other text is of that one with
score 1; a null doc_id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import annotate, row_of, text_slices

UNKNOWN = "und"
BUCKETS = 1 << 13
#: Weight of the average log-odds of an n-gram in a margin.
MARGIN = 24.0
SMOOTHING = 0.5 / BUCKETS
#: Two best losses closer than this make a text ambiguous.
AMBIGUOUS = 0.25
_KEPT = bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256)).lower()
_DROPPED = bytes(b for b in range(128) if not chr(b).isalpha() and b not in b" \t\n\x0b\x0c\r")
_IS_DROPPED = np.array([b in _DROPPED for b in range(256)])
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(data: bytes, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 2, 3: the buckets of the n-grams of letters and blanks of all rows, and
    where each row's begin (one more than rows)."""
    raw = np.frombuffer(data, np.uint8)
    gone = np.concatenate(([0], np.cumsum(_IS_DROPPED[raw])))
    bounds = offsets - gone[offsets]
    codes = np.frombuffer(data.translate(_KEPT, _DROPPED), np.uint8).astype(np.uint32)
    out = []
    h = codes
    for n, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        h = h[:-1] * np.uint32(factor) + codes[n - 1:] if len(h) > 1 else h[:0]
        inside = np.ones(len(h), bool)
        for back in range(1, n):  # n-grams that cross into the next row
            cross = bounds[1:-1] - back
            inside[cross[(cross >= 0) & (cross < len(h))]] = False
        at = np.flatnonzero(inside)
        mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        out.append(((mixed >> np.uint32(32 - 13)).astype(np.int64), np.searchsorted(at, bounds)))
    return out


def counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the rows (text, lang)."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                names = part.column(1).dictionary_encode()
                of_row = np.asarray(names.indices)
                k = len(names.dictionary)
                found = np.zeros(k * BUCKETS, np.int64)
                for buckets, first in grams(data, offsets):
                    found += np.bincount(of_row[row_of(np.arange(len(buckets)), first)] * BUCKETS + buckets, minlength=k * BUCKETS)
                for i, name in enumerate(names.dictionary.to_pylist()):
                    total[name] = total.get(name, 0) + found[i * BUCKETS:(i + 1) * BUCKETS]
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])],
                                             names=["lang", "bucket", "n"])

    return (rows.select(F.col("text").cast("string").alias("text"), "lang").mapInArrow(run, "lang string, bucket int, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1."""
    if k <= 7:
        splits = np.arange(1, 1 << max(k - 1, 0))
        return 1 - 2 * ((splits[None, :] >> np.arange(k)[:, None]) & 1)
    rng = np.random.default_rng(1)
    codes = [rng.choice([-1, 1], (k, 10 * math.ceil(math.log2(k)))) for _ in range(50)]
    nearest = [min((codes_i[i] != codes_i[j]).sum() for i in range(k) for j in range(i)) for codes_i in codes]
    return codes[int(np.argmax(nearest))]


class Model:
    """languages, their codewords, weights (bits x buckets) and the bits' weights in decoding."""

    def __init__(self, found: dict[str, np.ndarray]):
        self.languages = sorted(found)
        self.codes = codewords(len(found))
        share = np.array([found[x] / max(1, found[x].sum()) for x in self.languages]).reshape(len(found), BUCKETS)
        weights, apart = [], []
        for bit in self.codes.T:
            p, q = (share[bit == side].mean(axis=0) + SMOOTHING for side in (1, -1))
            w = np.log(p / p.sum()) - np.log(q / q.sum())
            weights.append(w)
            apart.append(float((p - q) @ w))
        self.weights = np.array(weights, np.float32).reshape(-1, BUCKETS)
        self.apart = np.array(apart) / np.mean(apart) if apart else np.zeros(0)

    def __call__(self, data: bytes, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[np.frombuffer(data, np.uint8)])))
        has = np.diff(letters[offsets]) > 0
        for i in np.flatnonzero(~has):
            has[i] = _LETTER.search(data[offsets[i]:offsets[i + 1]].decode()) is not None
        if not self.languages:
            has[:] = False
        margins, n = np.zeros((rows, len(self.weights))), np.zeros(rows)
        found = grams(data, offsets)
        for i in range(rows):
            parts = [buckets[first[i]:first[i + 1]] for buckets, first in found]
            n[i] = sum(map(len, parts))
            margins[i] = self.weights @ np.bincount(np.concatenate(parts), minlength=BUCKETS).astype(np.float32)
        margins *= (MARGIN / np.maximum(n, 1))[:, None]
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.apart
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows), np.ones(rows, bool)
        best = np.argmin(loss, axis=1)
        ordered = np.sort(loss, axis=1)
        score = 1 / np.exp(ordered[:, :1] - ordered).sum(axis=1)
        close = ordered[:, 1] - ordered[:, 0] < AMBIGUOUS if len(self.languages) > 1 else np.zeros(rows, bool)
        return [self.languages[i] if h else UNKNOWN for i, h in zip(best, has, strict=True)], np.where(has, score, 0.0), close | ~has


def learn(rows: DataFrame) -> Model:
    found = {}
    for r in counts(rows).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("v")).toLocalIterator():
        vector = np.zeros(BUCKETS, np.int64)
        for bucket, n in r["v"]:
            vector[bucket] = n
        found[r["lang"]] = vector
    return Model(found)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, all by default), lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(data, offsets):
            names, score, close = shared.value(data, offsets)
            return pa.array(names, pa.string()), pa.array(score), pa.array(close)
        return work

    return annotate(docs, docs.columns if keep is None else keep, make, "lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a language: all but those of ``und``.  Without learning
    rows there is no model to reject a text, and all with a letter stay."""
    model = learn(learning_rows(docs))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return predict(docs, model).filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    found = predict(docs, learn(learning_rows(docs)), ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
