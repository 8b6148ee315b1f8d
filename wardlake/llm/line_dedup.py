"""Line dedup by a segment-partition edit join.

Lines are the parts of a text between line feeds; blank ones are left alone.  Two lines of
more than k characters are near if their edit distance is at most k: ``edits``, or by
default one edit for each CHARS_PER_EDIT characters of the shorter line, at least one and
at most MOST_EDITS.  A line goes if an equal or a near line comes earlier (by doc_id, hash
of the text, line); ``dedup`` returns the texts without those lines.

1. Equal lines (128-bit hash) become one entry, with their first place.
2. An entry of length n is cut into k + 1 segments; each is indexed by (n, number, hash).
   At least one segment of a near line is intact.  So an entry probes, for its own and the
   smaller lengths, those of its substrings that can be that segment (their shift is
   bounded by the edits to the left and to the right of it).
3. Entries that meet must agree in all but 4 * k of 64 parity bits of their character
   pairs (k at its largest): an edit changes at most four pairs.
4. The rest is verified by a banded bit-parallel edit distance.
5. The lines that stay are gathered by the text of their first place, and each text is
   rebuilt from its own in line order.

Defined cases: null counts as empty (and stays null); lines of at most k characters have equal
lines only; rows that repeat doc_id and text count as one text and share their results; a
null doc_id comes last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.common import SPACES, mixed, powers, prefix_sums, runs, stage, text_slices

#: Edits by length: one for so many characters of the shorter line, and the most.
CHARS_PER_EDIT = 20
MOST_EDITS = 2
_LINE_FEED = 10
_BLANK = np.array([ord(c) for c in SPACES], np.uint32)


def limits(n: np.ndarray, edits: int | None) -> np.ndarray:
    """The edits within which a line of length n is near to one that is not shorter."""
    return np.full_like(n, edits) if edits is not None else np.clip(n // CHARS_PER_EDIT, 1, MOST_EDITS)


def segments(n: np.ndarray, edits: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of length n: even parts, the longer ones last."""
    base, more = n // (edits + 1), n % (edits + 1)
    short = edits + 1 - more
    return base * i + np.maximum(0, i - short), base + (i >= short)


def line_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int | None):
    """Of each line: two hashes, probe keys (0: none), parity word; and which probe keys are its index keys."""
    sums = prefix_sums(points)
    inverse = powers(len(points) + 1)[1]
    cut = lambda a, b: mixed((sums[b] - sums[a]) * inverse[a])
    tag = lambda n, i: mixed((n * (most + 1) + i).astype(np.uint64))
    most = MOST_EDITS if edits is None else edits
    n = ends - starts
    whole = cut(starts, ends)
    second = prefix_sums(mixed(points.astype(np.uint64)) & np.uint64(0xFFFFFFFF))
    ids = whole ^ tag(n, 0), mixed((second[ends] - second[starts]) * inverse[starts] + n.astype(np.uint64))
    index, probes = [], []  # an index key is a probe key too
    for less in range(most + 1):
        m = np.maximum(n - less, 0)
        k = limits(m, edits)
        for i in range(most + 1):
            at, size = segments(m, k, i)
            if not less:
                index.append(len(probes) + min(i, most - i))  # unshifted, it is the line's own segment
            for shift in range(max(-i, less - (most - i)), min(i, less + most - i) + 1):
                place = at + shift
                some = (n - less > k) & (i <= k) & (less <= k) & (shift >= less - (k - i)) & (shift <= less + k - i)
                some &= (place >= 0) & (place + size <= n)
                a = np.where(some, starts + place, 0)
                probes.append(np.where(some, cut(a, np.where(some, a + size, 0)) ^ tag(m, i), 0))
    pairs = mixed(points[:-1].astype(np.uint64) << np.uint64(32) | points[1:]) & np.uint64(63)
    upto = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << pairs)))
    return ids, probes, upto[np.maximum(ends - 1, starts)] ^ upto[starts], index


def _array(columns: list[np.ndarray]) -> pa.Array:
    flat = np.stack([c.astype(np.uint64) for c in columns], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(columns)), pa.array(flat.ravel().view(np.int64)))


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))


def _lines(texts: DataFrame, edits: int | None) -> DataFrame:
    schema = T.StructType([texts.schema["doc_id"], texts.schema["hash"], *T._parse_datatype_string(
        "line bigint, id binary, probes array<bigint>, bits bigint").fields])

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
                lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                bounds = lead[offsets]
                feed = points == _LINE_FEED
                starts, ends, row = runs(~feed, bounds)
                ink = np.concatenate(([0], np.cumsum(~np.isin(points, _BLANK))))
                some = ink[ends] > ink[starts]
                starts, ends, row = starts[some], ends[some], row[some]
                if not len(starts):
                    continue
                feeds = np.concatenate(([0], np.cumsum(feed)))
                ids, probes, bits, _ = line_keys(points, starts, ends, edits)
                take = pa.array(row)
                whole = np.stack(ids, axis=1).astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), pa.array(feeds[starts] - feeds[bounds[row]]),
                    pa.array([whole[i:i + 16] for i in range(0, len(whole), 16)], pa.binary()),
                    _array(probes), pa.array(bits.view(np.int64))], names=schema.names)

    return texts.mapInArrow(run, schema)


def distance_within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit-parallel over a, columns in the band only."""
    if abs(len(a) - len(b)) > edits:
        return False
    at = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        at += 1
    a, b = a[at:], b[at:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for j, c in enumerate(b):
        low = max(0, j - edits)
        match = where.get(c, 0) >> low << low & (1 << j + edits + 1) - 1  # the band
        zero = ((match & up) + up ^ up | match | down) & full
        plus, minus = (down | ~(zero | up)) & full, zero & up
        score += (plus >> len(a) - 1 & 1) - (minus >> len(a) - 1 & 1)
        if score - (len(b) - 1 - j) > edits:
            return False
        plus = (plus << 1 | 1) & full
        up, down = (minus << 1 | ~(zero | plus)) & full, zero & plus
    return score <= edits


def _near(pairs: DataFrame, edits: int | None) -> DataFrame:
    """Those of (a, b, x, y: the lines' texts) that are near."""
    def run(batches):
        for batch in batches:
            near = [distance_within(x, y, int(limits(np.array(min(len(x), len(y))), edits)))
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "a binary, b binary")


def entries(docs: DataFrame, edits: int | None = None) -> DataFrame:
    """One row per different line: id, first place (no_id, doc_id, hash, line), near: whether a
    near line comes earlier."""
    texts = _identified(docs)
    first = F.min(F.struct(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "line").alias("first"), "probes", "bits"))
    found = stage(_lines(texts, edits).groupBy("id").agg(first.alias("x")).select("id", "x.*"), "lines")
    probes = found.select(F.col("id").alias("a"), F.col("bits").alias("p"), F.explode("probes").alias("key")).filter("key != 0")
    none = np.zeros(0, np.int64)
    own = F.array(*[F.get("probes", F.lit(i)) for i in line_keys(np.zeros(0, np.uint32), none, none, edits)[3]])
    index = found.select(F.col("id").alias("b"), F.col("bits").alias("q"), F.explode(own).alias("key")).filter("key != 0")
    differ = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    met = probes.join(index, "key").filter((F.col("a") != F.col("b")) & (differ <= 4 * (MOST_EDITS if edits is None else edits)))
    pairs = stage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(found.select("id", "first"), "id")
    by_text = wanted.groupBy("first.doc_id", "first.hash").agg(F.collect_list(F.struct("first.line", "id")).alias("wanted"))
    same = texts["doc_id"].eqNullSafe(by_text["doc_id"]) & texts["hash"].eqNullSafe(by_text["hash"])
    written = (texts.join(by_text, same).select(F.split("text", "\n").alias("parts"), F.explode("wanted").alias("w"))
               .select("w.id", F.get("parts", F.col("w.line").cast("int")).alias("written")).dropDuplicates(["id"]))
    written = stage(written, "line-texts")
    near = _near(pairs.join(written.select(F.col("id").alias("a"), F.col("written").alias("x")), "a")
                 .join(written.select(F.col("id").alias("b"), F.col("written").alias("y")), "b").select("a", "b", "x", "y"), edits)
    both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    places = found.select("id", "first")
    earlier = (both.join(places.select(F.col("id").alias("b"), F.col("first").alias("other")), "b")
               .groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other")))
    return places.join(earlier, "id", "left").select("id", "first", F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("near"))


def _rebuilt(docs: DataFrame, keep: list[str], edits: int | None) -> DataFrame:
    """Per row of ``docs``: row (the columns ``keep``), kept (its text without the lines that go),
    and the numbers of its lines that are not blank, first places and near ones."""
    found = entries(docs, edits).groupBy("first.doc_id", "first.hash").agg(
        F.collect_list(F.when(~F.col("near"), F.col("first.line"))).alias("stay"),
        F.count(F.lit(1)).alias("firsts"), F.count_if("near").alias("near"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("whole"),
                        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    same = whole["id"].eqNullSafe(found["doc_id"]) & whole["text_hash"].eqNullSafe(found["hash"])
    joined = whole.join(found, same, "left").select("row", "whole", "stay", "firsts", "near")
    schema = T.StructType([joined.schema["row"], *T._parse_datatype_string("kept string, n_lines bigint, firsts bigint, near bigint").fields])

    def run(batches):
        for batch in batches:
            kept, lines = [], []
            for whole, stay in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, stay = whole.split("\n"), set(stay or ())
                ink = [bool(x.strip(SPACES)) for x in parts]
                lines.append(sum(ink))
                kept.append("\n".join(x for i, x in enumerate(parts) if i in stay or not ink[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()),
                                              *(batch.column(i).fill_null(0) for i in (3, 4))], names=schema.names)

    return joined.mapInArrow(run, schema)


def dedup(docs: DataFrame, edits: int | None = None) -> DataFrame:
    """The rows of ``docs`` with texts without the lines that go."""
    text = F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text")
    return _rebuilt(docs, docs.columns, edits).select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def result(docs: DataFrame, edits: int | None = None) -> DataFrame:
    """Per document: lines that are not blank, lines that go for an equal one, and for a near one;
    hash of the text that is kept."""
    return _rebuilt(docs, ["doc_id"], edits).select(
        "row.doc_id", "n_lines", (F.col("n_lines") - F.col("firsts")).alias("n_equal"), F.col("near").alias("n_near"),
        F.sha2("kept", 256).alias("kept_sha256"))


def digest(docs: DataFrame, edits: int | None = None) -> DataFrame:
    """The counts of ``result``."""
    return result(docs, edits).drop("kept_sha256")
