"""Spelling variants: words one letter apart, found by PartEnum signatures.

A word's letters with their occurrence numbers (the second "e" is another element than the first)
are the ones of a binary vector.  One inserted, deleted or replaced letter changes at most two
of its places.  The places are cut into FIRST partitions of SECOND parts each; two vectors that
differ in at most two places agree, in some partition, on all parts but a few.  Every choice of
parts that may agree gives a signature, words are joined on equal signatures and the joined
pairs verified by edit distance.

A signature with more than HEAVY words is joined on one half of the word besides: two words one
letter apart share what is before or what is behind the middle of the shorter one.  So no
group is compared whole, and no pair is lost.

A word's form is its near word of the largest count (ties: the smallest in code-point order), if
that count is at least RATIO times its own; its root is the last form that forms lead to.

Null and empty texts have no words; a null doc_id counts as an empty one; rows that repeat
count as often as they are there; words may be of any length; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import mixed, stage

#: PartEnum: partitions, parts of each, and the places that may differ.
FIRST, SECOND, APART = 1, 5, 2
#: Words of one signature that are joined on the signature alone.
HEAVY = 30
#: Length and count of a word, and how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One of so many (document, run) has a letter deleted.
DAMAGED = 199
#: Different words that a task counts before it passes them on.
HELD_WORDS = 1 << 18


def damaged(doc: str, run: str) -> str:
    """The run, without one letter where the contract's checksum says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: the words of all texts that are long and frequent enough."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
    slim = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        found: Counter[str] = Counter()
        ready = lambda: pa.RecordBatch.from_pydict({"word": list(found), "n": pa.array(found.values(), pa.int64())})
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                doc = doc.as_py()
                for word, n in Counter(runs.findall(text.lower().decode())).items():  # bytes: A-Z only
                    word = damaged(doc, word)
                    if len(word) >= LEAST_LENGTH:
                        found[word] += n
                if len(found) > HELD_WORDS:
                    yield ready()
                    found.clear()
        if found:
            yield ready()

    counted = slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def choices() -> list[tuple[int, ...]]:
    """The parts of each signature (part numbers over all partitions)."""
    differ = APART // FIRST  # in the partition with the fewest different places
    if SECOND <= differ:
        raise ValueError("more parts are needed than places that may differ")
    return [tuple(i * SECOND + j for j in kept)
            for i in range(FIRST) for kept in combinations(range(SECOND), SECOND - differ)]


def signature_values(words: list[str]) -> np.ndarray:
    """A row of signatures for each word: hashes of the elements in the chosen parts."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, row))
    letters, row = letters[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    occurrence = np.arange(len(row)) - np.repeat(starts, np.diff([*starts, len(row)]))
    element = mixed((letters << np.uint64(32)) + occurrence.astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(words), FIRST * SECOND), np.uint64)
    np.add.at(sums, (row, ((element >> np.uint64(40)) % np.uint64(FIRST * SECOND)).astype(np.int64)), element)
    out = [mixed(sums[:, list(parts)].sum(axis=1, dtype=np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
           for i, parts in enumerate(choices())]
    return np.stack(out, axis=1).view(np.int64)


def signatures(words: DataFrame) -> DataFrame:
    """``signature``, ``word``, ``n`` for every signature of every word."""
    def run(batches):
        for batch in batches:
            values = signature_values(batch.column(0).to_pylist())
            each = pa.array(np.repeat(np.arange(len(values)), values.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), batch.column(0).take(each), batch.column(1).take(each)],
                                             names=["signature", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "signature long, word string, n long")


def halves(word):
    """Keys of which two words one letter apart share one: what is before, or behind, the middle
    of the shorter.  A word may be the shorter one (or as long as the other), or the longer."""
    n = F.length(word)
    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    key = lambda side, size, part: F.concat(F.lit(side), size.cast("string"), F.lit(":"), part)
    rest = lambda start: F.substring(word, start + 1, n)
    return F.array(key("a", n, F.substring(word, F.lit(1), half)), key("b", n, rest(half)),
                   key("a", n - 1, F.substring(word, F.lit(1), less)), key("b", n - 1, rest(less + 1)))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words one letter apart, each once: word, n, other, other_n (word < other)."""
    every = stage(signatures(words), "signatures")
    sizes = every.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    # keys that are equal by chance are told apart by the verification
    parts = F.transform(halves(F.col("word")), lambda half: F.xxhash64("signature", half))
    keys = F.when(F.col("size") <= HEAVY, F.array("signature")).otherwise(parts)
    a = stage(every.join(sizes, "signature").select(F.explode(keys).alias("key"), "word", "n"), "keyed")
    b = a.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    close = (F.col("word") < F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1) & (
        F.levenshtein("word", "other", 1) == 1)
    return a.join(b, "key").filter(close).select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for words with a form: each round doubles the steps taken.  Counts grow by
    RATIO a step, so that a few rounds reach the end."""
    up = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(up.join(on, "root", "left"), "roots")
        up = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next is not null").isEmpty():
            return up


def variants(docs: DataFrame) -> DataFrame:
    """Every word with its near words' number, form and root."""
    words = stage(word_counts(docs), "words")
    pairs = near_pairs(words)
    flip = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))
    near = (pairs.unionAll(flip).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    form_n = -F.col("best.minus")
    frequent = form_n >= RATIO * F.col("n")
    found = stage(words.join(near, "word", "left").select(
        "word", F.when(frequent, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, form_n).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_UPPER = "".join(map(chr, range(65, 91)))
SQL = f"""WITH RECURSIVE
  crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)) x),
  runs AS (SELECT doc, run, count(*) AS n FROM (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
        unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
      FROM documents) x WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
  bytes AS (SELECT run, n, hex(encode(doc || ':' || run)) AS h FROM runs),
  sums AS (SELECT run, n, xor(4294967295, list_reduce(
      list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h FROM bytes, crc),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT n, CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
      FROM sums) x WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
  less AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS k
      FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS p FROM w) x),
  near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.p = b.p AND a.word <> b.word
      UNION SELECT a.word, a.n, w.word, w.n FROM less a JOIN w ON a.k = w.word
      UNION SELECT w.word, w.n, a.word, a.n FROM less a JOIN w ON a.k = w.word),
  best AS (SELECT word, count(*) AS n_near, min({{'m': -other_n, 'o': encode(other)}}) AS b FROM near GROUP BY 1),
  f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {RATIO} * n THEN decode(b.o) END AS form,
      CASE WHEN -b.m >= {RATIO} * n THEN -b.m END AS form_n FROM w LEFT JOIN best USING (word)),
  path AS (SELECT word, word AS last, 0 AS step FROM w
      UNION ALL SELECT path.word, f.form, step + 1 FROM path JOIN f ON f.word = path.last WHERE f.form IS NOT NULL),
  ends AS (SELECT word, arg_max(last, step) AS root FROM path GROUP BY 1)
  SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""
