"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows,
looked up for every window of every document; hits are verified word by word.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters from U+0080
up.  A window is ten consecutive words of an item; an item of one to nine words is
one window.  Documents are not shuffled.

The set is built from at most SET_BYTES of item text.  A larger benchmark goes in
several passes over the documents, each with the next part of the items, so the
broadcast keeps its bound and no item is left out.

Defined cases: null and blank texts have no words and no hits; items without words
have no windows; items with equal windows are all reported; repeated rows of an item
count once; an item with a null id is named 'null'; an empty benchmark hits nothing;
an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import annotate, mixed, powers, prefix_sums, runs, stage

WINDOW = 10
SET_BYTES = 32 << 20
_FILTER_BITS = 22
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_parts(benchmark: DataFrame, limit: int = SET_BYTES):
    """Windows (words joined by a space) with their items, in parts of bounded size."""
    windows: dict[bytes, set[str]] = {}
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").filter(F.col("text").isNotNull())
    for r in rows.toLocalIterator():
        words = _WORDS.findall(r["text"].encode().translate(_LOWER))
        for i in range(min(len(words), 1) and max(1, len(words) - WINDOW + 1)):
            windows.setdefault(b" ".join(words[i:i + WINDOW]), set()).add("null" if r["id"] is None else r["id"])
        size += len(r["text"])
        if size >= limit:
            yield windows
            windows, size = {}, 0
    if windows:
        yield windows


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(length)[0]):
        total += words[j:j + n] * p
    return mixed(total)


def _words(data: bytes, offsets: np.ndarray):
    low = data.translate(_LOWER)
    raw = np.frombuffer(low, np.uint8)
    starts, ends, row = runs(_IS_WORD[raw], offsets)
    sums = prefix_sums(raw)
    return low, starts, ends, row, mixed((sums[ends] - sums[starts]) * powers(len(raw) + 1)[1][starts])


class Finder:
    """Finds the windows of one part in texts."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.windows = windows
        self.by_length: dict[int, np.ndarray] = {}
        joined: dict[int, list[bytes]] = {}
        for w in windows:
            joined.setdefault(w.count(b" ") + 1, []).append(w)
        for length, texts in joined.items():
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            hashes = _words(b"".join(texts), offsets)[4].reshape(len(texts), length)
            found = np.concatenate([_window_hashes(h, length) for h in hashes])
            self.by_length[length] = table = np.zeros(1 << _FILTER_BITS, bool)
            table[found & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def __call__(self, data: bytes, offsets: np.ndarray):
        """(rows' word counts, hit words as (row, start byte, end byte), items of each row)."""
        rows = len(offsets) - 1
        low, starts, ends, row, hashes = _words(data, offsets)
        edges = np.zeros(len(starts) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(rows)]
        for length, table in self.by_length.items():
            h = _window_hashes(hashes, length)
            may = table[h & np.uint64((1 << _FILTER_BITS) - 1)]
            may &= row[:len(h)] == row[length - 1:]
            for i in np.flatnonzero(may).tolist():
                text = b" ".join([low[a:b] for a, b in zip(starts[i:i + length], ends[i:i + length], strict=True)])
                if (of := self.windows.get(text)) is not None:
                    edges[i] += 1
                    edges[i + length] -= 1
                    items[row[i]] |= of
        hit = np.cumsum(edges[:-1]) > 0
        return np.bincount(row, minlength=rows), (row[hit], starts[hit], ends[hit], np.flatnonzero(hit)), items


def _spans(hits, rows: int, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Hit words that follow each other make one span, in bytes of the text."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    last = -2
    for r, a, b, k in zip(*(x.tolist() for x in hits), strict=True):
        at = int(offsets[r])
        if k == last + 1 and out[r]:
            out[r][-1] = (out[r][-1][0], b - at)
        else:
            out[r].append((a - at, b - at))
        last = k
    return out


def _parts_and_more(benchmark: DataFrame, limit: int):
    parts = item_parts(benchmark, limit)
    now = next(parts, {})
    while now is not None:
        following = next(parts, None)
        yield now, following is not None
        now = following


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, limit: int = SET_BYTES) -> DataFrame:
    """``row`` (the columns ``keep`` of each row, all by default), n_words, n_hit,
    spans (start and end bytes of runs of hit words in the UTF-8 text), items."""
    keep = docs.columns if keep is None else keep
    state = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    fields = "spans array<struct<start:bigint,end:bigint>>, words array<bigint>, items array<string>"
    first = True
    for windows, more in _parts_and_more(benchmark, limit):
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def make(shared=shared):
            find = Finder(shared.value)

            def work(data, offsets):
                rows = len(offsets) - 1
                counts, hits, items = find(data, offsets)
                words: list[list[int]] = [[] for _ in range(rows)]
                before = np.concatenate(([0], np.cumsum(counts)))
                for r, k in zip(hits[0].tolist(), hits[3].tolist(), strict=True):
                    words[r].append(int(k - before[r]))
                spans = [[{"start": a, "end": b} for a, b in s] for s in _spans(hits, rows, offsets)]
                return (pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(words, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())))
            return work

        carried = ["row", *([] if first else ["seen"]), *(["text"] if more else [])]
        found = annotate(state, carried, make, f"n_words bigint, {fields}")
        names = ("spans", "words", "items")
        joined = [F.col(n) if first else F.array_union(F.col(n), F.col(f"row.seen.{n}")).alias(n) for n in names]
        state = found.select("row.row", *(["row.text"] if more else []), "n_words", *joined)
        if more:
            state = stage(state.select("row", "text", F.struct(*names).alias("seen")), "decontaminate")
        first = False
    return state.select("row", "n_words", F.size("words").cast("long").alias("n_hit"),
                        F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no window hits."""
    return scan(docs, benchmark).filter("n_hit = 0").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every run of hit words cut from the text; null stays null."""
    whole = F.encode(F.col("row.text"), "UTF-8")
    piece = lambda a, b: F.decode(F.substring(whole, a + 1, b - a), "UTF-8")
    cut = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["text"], F.when(s["start"] > acc["at"], piece(acc["at"], s["start"])).otherwise("")).alias("text")),
        lambda acc: F.concat(acc["text"], piece(acc["at"], F.octet_length(F.col("row.text")).cast("long"))))
    return (scan(docs, benchmark)
            .withColumn("row", F.when(F.col("n_hit") > 0, F.col("row").withField("text", cut)).otherwise(F.col("row")))
            .select("row.*"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(docs, benchmark, ["doc_id"]).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT k, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p)),
occ AS (SELECT k, dw.n, p, item FROM dw JOIN iw USING (win, n)),
hit AS (
  SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT k, n, p FROM occ), LATERAL (SELECT unnest(range(p, p + n)) AS q)
  GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM occ) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""
