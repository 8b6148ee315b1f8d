"""License scans: winnowed fingerprints of license texts find candidates, a banded
alignment reports how much of a license a document holds, and where.

Words are runs of letters a-z (A-Z lower-cased), digits and characters from U+0080 up.  A
fingerprint is the hash of GRAM words in a row; of every WINNOW neighbouring ones of a
template the least is kept, so a run of GRAM + WINNOW - 1 shared words always shares one.
The inverted index from fingerprints to (template, place) is broadcast; templates of more
than MAX_TEMPLATE_BYTES in all are refused.  Documents are not shuffled.

A template is aligned with the words around the fingerprints shared with it, three times
its length to each side, if they have enough of its words at all.  The alignment chains
parts over words put in: a part of w words over fewer than 3 w.  Coverage is the share of
the template's words that it matches; a match has at least ``coverage``.  Of overlapping
matches of one template the best, then the first, is reported; the rest of the text is
aligned anew.  A match of which over half lies in better ones (by the alignment's score) of
other templates is not reported; equally good ones all are.

A statement (a template of at most STATEMENT_WORDS words) names its license after the word
"under", or throughout: those words stand in the document one by one and without others
between them, and no "not" stands in the match before them or shortly before it.

Defined cases: null and blank texts have no matches; a template of fewer than GRAM words
is one fingerprint; templates without words, or null, are never found; repeated templates
with one id count once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm.common import annotate, mixed, powers, prefix_sums, runs
from wardlake.llm.license_texts import LONG, SHORT

GRAM = 3
WINNOW = 2
BAND = 8
COVERAGE = 0.8
#: A template of so many words at most is a statement.
STATEMENT_WORDS = 16
#: Words before a statement among which a "not" denies it.
DENIED = 3
MAX_TEMPLATE_BYTES = 8 << 20
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FILTER = np.uint64((1 << 20) - 1)

# License statements and short license texts as their publishers word them.
TEMPLATES = {
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-statement": "Released under the MIT License.",
    **SHORT,
    **LONG,
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
}


def hashed_words(data: bytes, offsets: np.ndarray):
    low = data.lower()
    raw = np.frombuffer(low, np.uint8)
    starts, ends, row = runs(_IS_WORD[raw], offsets)
    sums = prefix_sums(raw)
    return row, mixed((sums[ends] - sums[starts]) * powers(len(raw) + 1)[1][starts])


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j, p in enumerate(powers(n)[0]):
        total += words[j:j + len(total)] * p
    return mixed(total)


def winnowed(marks: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the least (the last of equals) of each window."""
    if len(marks) <= window:
        return [len(marks) - 1 - int(np.argmin(marks[::-1]))] if len(marks) else []
    least = np.lib.stride_tricks.sliding_window_view(marks, window)[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(window - 1, len(marks)) - least).tolist()


#: A state of the alignment in 64 bits: score, matched words, place of the first of them.
_BEGIN, _MATCHED = 22, 17
_ONE = np.int64(1 << _BEGIN + _MATCHED)
_MATCH = 2 * _ONE + np.int64(1 << _BEGIN)
_REGION = 1 << 21


def aligned(template: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end in the document: score, matched words of the template and place of the first
    of them, of the best alignment of the whole template; 2 for a match, -1 for a word changed,
    left out or put in."""
    places = np.arange(len(words) + 1, dtype=np.int64)
    ramp, now = places * _ONE, places
    for word in template:
        after = now - _ONE  # the template's word is left out
        np.maximum(after[1:], now[:-1] + np.where(words == word, _MATCH, -_ONE), out=after[1:])
        after += ramp  # the document has words more
        np.maximum.accumulate(after, out=after)
        now = after - ramp
    return now >> _BEGIN + _MATCHED, now >> _BEGIN & (1 << _MATCHED) - 1, now & (1 << _BEGIN) - 1


def shared(bag: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> int:
    """The words of a template (different ones, their counts) that a text has at all: no alignment matches more."""
    some, counts = np.unique(words, return_counts=True)
    if not len(some):
        return 0
    at = np.minimum(np.searchsorted(some, bag[0]), len(some) - 1)
    return int(np.minimum(bag[1], counts[at])[some[at] == bag[0]].sum())


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.coverage = coverage
        self.words: list[np.ndarray] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        self.named: list[np.ndarray] = []  # the words of a statement that name its license
        under, self.denial = hashed_words(b"under not", np.array([0, 9]))[1]
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {}  # gram length, fingerprint, places
        for k, name in enumerate(self.names):
            data = templates[name].encode()
            _, words = hashed_words(data, np.array([0, len(data)]))
            if len(words) >> _MATCHED:
                raise ValueError(f"template {name} of {len(words)} words; at most {(1 << _MATCHED) - 1} are aligned")
            self.words.append(words)
            self.bags.append(np.unique(words, return_counts=True))
            at = np.flatnonzero(words == under)
            self.named.append(words[at[0] + 1 if len(at) else 0:] if len(words) <= STATEMENT_WORDS else words[:0])
            length = min(GRAM, len(words))
            if length:
                marks = grams(words, length)
                for place in winnowed(marks):
                    self.index.setdefault(length, {}).setdefault(int(marks[place]), []).append((k, place))
        self.filters = {}
        for length, found in self.index.items():
            self.filters[length] = np.zeros(int(_FILTER) + 1, bool)
            self.filters[length][np.array(list(found), np.uint64) & _FILTER] = True

    def __call__(self, data: bytes, offsets: np.ndarray) -> list[list[dict]]:
        row, words = hashed_words(data, offsets)
        first = np.searchsorted(row, np.arange(len(offsets)))
        seeds: dict[tuple[int, int], list[int]] = {}
        for length, found in self.index.items():
            marks = grams(words, length)
            may = self.filters[length][marks & _FILTER] & (row[:len(marks)] == row[length - 1:])
            for i in np.flatnonzero(may).tolist():
                for k, place in found.get(int(marks[i]), ()):
                    r = int(row[i])
                    seeds.setdefault((r, k), []).append(i - int(first[r]) - place)
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for (r, k), diagonals in seeds.items():
            text = words[first[r]:first[r + 1]]
            if len(text) >= self.coverage * len(self.words[k]):
                out[r].extend(self.matches(k, text, sorted(set(diagonals))))
        return [best(x) for x in out]

    def stated(self, k: int, text: np.ndarray, a: int, z: int) -> bool:
        """Whether the match text[a:z] holds what a statement must; other templates need nothing more."""
        named = self.named[k]
        if not len(named):
            return True
        at = z - len(named)
        return at >= 0 and np.array_equal(text[at:z], named) and self.denial not in text[max(0, a - DENIED):at]

    def matches(self, k: int, text: np.ndarray, diagonals: list[int]):
        """Matches of one template that do not overlap, the best first."""
        template, n = self.words[k], len(self.words[k])
        need, reach = max(1, self.coverage * n), max(3 * n, BAND + BAND // 2)
        regions: list[tuple[int, int]] = []
        for d in diagonals:
            lo, hi = max(0, d - reach), min(len(text), d + n + reach)
            if regions and lo <= regions[-1][1]:
                regions[-1] = regions[-1][0], hi
            else:
                regions.append((lo, hi))
        regions = [(at, min(hi, at + _REGION + 8 * n)) for lo, hi in regions for at in range(lo, hi, _REGION)]
        taken = np.zeros(len(text), bool)
        while regions:
            lo, hi = regions.pop()
            if hi - lo < need or shared(self.bags[k], text[lo:hi]) < need:
                continue
            score, matched, begin = aligned(template, text[lo:hi])
            ends = np.flatnonzero(matched >= need)
            ends = ends[(ends == 0) | (score[ends] != score[ends - 1] - 1) | (begin[ends] != begin[ends - 1])
                        | (matched[ends] != matched[ends - 1])]  # not one with more words put in after its last
            cuts = [lo]
            for e in ends[np.lexsort((ends, -matched[ends], -score[ends]))].tolist():
                a, z = lo + int(begin[e]), lo + e
                if not taken[a:z].any() and self.stated(k, text, a, z):
                    taken[a:z] = True
                    cuts += [a, z]
                    yield {"license": self.names[k], "first": a, "end": z, "coverage": int(matched[e]) / n, "score": int(score[e])}
            if len(cuts) > 1:
                cuts = [*sorted(cuts), hi]
                regions += zip(cuts[::2], cuts[1::2], strict=True)


def best(found: list[dict]) -> list[dict]:
    """Without the matches that have over half of their words in better ones of other templates."""
    over = np.zeros(max((x["end"] for x in found), default=0), np.int64)
    out = []
    for x in sorted(found, key=lambda x: -x["score"]):
        place = over[x["first"]:x["end"]]
        if 2 * int((place > x["score"]).sum()) <= len(place):
            np.maximum(place, x["score"], out=place)
            out.append({c: x[c] for c in ("license", "first", "end", "coverage")})
    return sorted(out, key=lambda x: (x["first"], x["license"]))


_MATCHES = "matches array<struct<license:string,first:bigint,end:bigint,coverage:double>>"


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def scan(docs: DataFrame, templates: DataFrame, keep: list[str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``row`` (the columns ``keep``, all by default) and matches: license, first and end word, coverage."""
    size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {MAX_TEMPLATE_BYTES} are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(
        {r["license"]: r["text"] for r in templates.collect() if r["license"] is not None and r["text"] is not None})
    kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def make():
        find = Scanner(shared.value, coverage)
        return lambda data, offsets: (pa.array(find(data, offsets), kind),)

    return annotate(docs, docs.columns if keep is None else keep, make, _MATCHES)


def digest(docs: DataFrame, templates: DataFrame) -> DataFrame:
    return scan(docs, templates, ["doc_id"]).select(
        "row.doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct("matches.license"))).alias("licenses"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("best_coverage"), "matches")
