"""Dedup of byte strings that occur twice: every byte covered by a ``match``-byte string
that also starts elsewhere is removed.

The method is a merge of sorted suffix shards by iterative interleave refinement, over a
sparse set of suffixes.  A merge of whole Burrows-Wheeler transforms refines the interleave
of all suffixes once per byte of common prefix, here 400 passes over the corpus; so the
suffixes taken are those at *anchors*, and only where the common prefix is still open is
the interleave refined, byte by byte:

1. Every window of ``match`` bytes has one anchor (see ``anchors``), at a place fixed by
   the window's bytes.  Anchors are keyed by the hash of the ``core`` bytes after them,
   which lie in the window, so equal windows have anchors of one key.
2. Keys that occur once are dropped: their windows occur once.
3. Anchors of a key that also agree in the ``reach - 1`` bytes before and after the core
   stand in equal surroundings: all their windows occur again.  One per group is kept.
4. Groups of a key, merged from all shards, start as one interval.  Passes refine the order
   by one byte: to the right, and by the byte before (the transform's symbol) to the left.
   The pass that parts two suffixes is their common prefix; a window with d bytes before
   its anchor is repeated if its left interval of depth d and its right interval of depth
   reach - 1 - d together hold another group.

Keys are 64-bit hashes; texts are not copied into the shuffle of anchors.  Keys with more
than ``CHUNK`` groups are compared by counting hashes of their windows instead.

Defined cases: null counts as empty; texts of under ``match`` bytes lose nothing; rows that
repeat doc_id and text are occurrences of their own and all lose their bytes; a null doc_id
is allowed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.common import mixed, powers, prefix_sums, stage, text_slices

MATCH = 400
#: Windows that one anchor can stand for; the core has MATCH - REACH + 1 bytes.
REACH = 192
#: Groups that a task refines at once; rows of one key that are dealt to one task.
CHUNK = 20_000
#: ``at`` packs first window, anchor's distance from it, and number of windows.
_BITS = 20


def anchors(data: bytes, offsets: np.ndarray, match: int = MATCH, reach: int = REACH):
    """The places that stand for all windows of ``match`` bytes.

    Of the ``reach`` substrings of match - reach + 1 bytes in a window the one with the
    least hash (the leftmost of equals) is the window's anchor: equal windows have it at
    the same distance.  Returns (row, anchor, first window, number of windows, hash of the
    anchor's core, prefix sums of the hash); windows of one anchor follow each other."""
    raw = np.frombuffer(data, np.uint8)
    core = match - reach + 1
    n = len(raw) - match + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, np.uint64), None
    sums = prefix_sums(raw)
    m = len(raw) - core + 1
    key = mixed((sums[core:] - sums[:m]) * powers(len(raw) + 1)[1][:m])
    bits = np.uint64(max(1, int(m - 1).bit_length()))
    step, width = (key >> bits << bits) | np.arange(m, dtype=np.uint64), 1
    while width < reach:  # sliding minimum by doubling
        by = min(width, reach - width)
        step = np.minimum(step[:len(step) - by], step[by:])
        width += by
    chosen = (step[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + match <= offsets[row + 1]
    first = inside.copy()
    first[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    at = np.flatnonzero(first)
    windows = np.add.reduceat(inside, at, dtype=np.int64) if len(at) else none
    return row[at], chosen[at], at, windows, key[chosen[at]], sums


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, text): rows that agree in the first two are copies of each other."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))


def _anchored(rows: DataFrame, match: int, reach: int) -> DataFrame:
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("hash", "key", "near", "at"))])
    around = match + reach - 1

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                row, anchor, first, windows, key, sums = anchors(data, offsets, match, reach)
                if not len(row):
                    continue
                low = np.maximum(anchor - (reach - 1), offsets[row])
                high = np.minimum(anchor - (reach - 1) + around, offsets[row + 1])
                near = mixed((sums[high] - sums[low]) * powers(len(data) + 1)[1][low] + mixed(((anchor - low) << 32 | (high - anchor)).astype(np.uint64)))
                at = (first - offsets[row]) << _BITS | (anchor - first) << (_BITS // 2) | windows
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), pa.array(key.view(np.int64)), pa.array(near.view(np.int64)), pa.array(at)],
                    names=schema.names)

    return rows.select("doc_id", "hash", "text").mapInArrow(run, schema)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor, number of windows."""
    half = (1 << _BITS // 2) - 1
    first = at >> _BITS
    return first, first + (at >> _BITS // 2 & half), at & half


class Interleave:
    """The order of suffixes, refined by one byte per pass; ``interval`` numbers those
    that agree so far."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.interval = self._numbered(keys)

    def _numbered(self, values: np.ndarray) -> np.ndarray:
        in_order = values[self.order]
        parts = np.concatenate(([False], in_order[1:] != in_order[:-1]))
        out = np.empty(len(values), np.int64)
        out[self.order] = np.cumsum(parts)
        return out

    def refine(self, symbols: np.ndarray) -> None:
        values = self.interval << 8 | symbols
        self.order = self.order[np.argsort(values[self.order], kind="stable")]
        self.interval = self._numbered(values)


def unrepeated(keys: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray, reach: int = REACH):
    """Windows that no other group shares.  left[i, d]: the byte d + 1 before the anchor of
    group i; right[i, d]: the byte d after its core.  Returns (group, window), ascending."""
    first, anchor, windows = _unpacked(at)
    side = Interleave(keys)
    depths = [side.interval]
    for d in range(reach - 1):
        side.refine(right[:, d])
        depths.append(side.interval)
    side = Interleave(keys)
    groups, places = [], []
    for d in range(reach):
        if d:
            side.refine(left[:, d - 1])
        some = np.flatnonzero((first <= anchor - d) & (anchor - d < first + windows))
        if len(some):
            both = side.interval[some] * (len(keys) + 1) + depths[reach - 1 - d][some]
            _, of, n = np.unique(both, return_inverse=True, return_counts=True)
            alone = some[n[of] == 1]
            groups.append(alone)
            places.append(anchor[alone] - d)
    group, place = np.concatenate(groups), np.concatenate(places)
    order = np.lexsort((place, group))
    return group[order], place[order]


_SURROUNDINGS = "key bigint, size bigint, at bigint, left binary, right binary"


def _surroundings(texts: DataFrame, match: int, reach: int) -> DataFrame:
    """From (doc_id, hash, text, found: array of (key, size, at)) the bytes around each anchor,
    padded with zeros where the text ends (no window reaches there)."""
    schema = T.StructType([texts.schema["doc_id"], texts.schema["hash"], *T._parse_datatype_string(_SURROUNDINGS).fields])
    core = match - reach + 1

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(2)[i].as_py() or "").encode()
                found = batch.column(3)[i].as_py()
                _, anchor, _ = _unpacked(np.array([f["at"] for f in found], np.int64))
                n = len(found)
                left = [text[max(0, a - reach + 1):a][::-1].ljust(reach - 1, b"\0") for a in anchor.tolist()]
                right = [text[a + core:a + core + reach - 1].ljust(reach - 1, b"\0") for a in anchor.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(batch.column(0)[i], n), pa.repeat(batch.column(1)[i], n),
                    *(pa.array([f[c] for f in found], pa.int64()) for c in ("key", "size", "at")),
                    pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=schema.names)

    return texts.mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _refined(surroundings: DataFrame, reach: int, chunk: int) -> DataFrame:
    """(doc_id, hash, first, windows): runs of windows that occur once."""
    schema = T.StructType([surroundings.schema["doc_id"], surroundings.schema["hash"],
                           T.StructField("first", T.LongType()), T.StructField("windows", T.LongType())])

    def solve(table: pa.Table):
        table = table.combine_chunks()
        columns = {n: table.column(n).combine_chunks() if table.column(n).num_chunks != 1 else table.column(n).chunk(0) for n in table.schema.names}
        size = np.asarray(columns["size"])
        group, place = unrepeated(np.asarray(columns["key"]), _matrix(columns["left"], reach - 1), _matrix(columns["right"], reach - 1),
                                  np.asarray(columns["at"]), reach)
        single = size[group] == 1
        group, place = group[single], place[single]
        starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (place[1:] != place[:-1] + 1)))) if len(group) else group
        take = pa.array(group[starts])
        return pa.RecordBatch.from_arrays([
            columns["doc_id"].take(take), columns["hash"].take(take), pa.array(place[starts]),
            pa.array(np.diff(np.append(starts, len(group))).astype(np.int64))], names=schema.names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk:
                continue
            table = pa.Table.from_batches(held)
            keys = np.asarray(table.column("key"))
            whole = int(np.searchsorted(keys, keys[-1]))  # all but the last key, which may go on
            if whole:
                yield solve(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            yield solve(pa.Table.from_batches(held))

    return surroundings.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _counted(surroundings: DataFrame, reach: int) -> DataFrame:
    """The same for keys with very many groups, by a hash of each window's bytes around the core."""
    one = T.StructType([surroundings.schema["doc_id"], surroundings.schema["hash"],
                        *(T.StructField(n, T.LongType()) for n in ("key", "size", "first", "window"))])

    def run(batches):
        for batch in batches:
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                first, anchor, windows = _unpacked(np.asarray(piece.column("at")))
                left, right = (_matrix(piece.column(n), reach - 1) for n in ("left", "right"))
                whole = prefix_sums(np.concatenate((left[:, ::-1], right), axis=1).ravel())
                group = np.repeat(np.arange(len(first)), windows)
                place = np.arange(len(group)) - np.repeat(np.cumsum(windows) - windows, windows) + first[group]
                begin = group * (2 * reach - 2) + (reach - 1) - (anchor[group] - place)
                inverse = powers(len(whole))[1]
                h = mixed((whole[begin + reach - 1] - whole[begin]) * inverse[begin] + mixed((anchor[group] - place).astype(np.uint64)))
                take = pa.array(group)
                yield pa.RecordBatch.from_arrays([*(piece.column(n).take(take) for n in ("doc_id", "hash", "key", "size")),
                                                  pa.array(place), pa.array(h.view(np.int64))], names=one.names)

    groups = surroundings.mapInArrow(run, one).groupBy("key", "window").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min(F.struct("doc_id", "hash", "first")).alias("of"))
    return groups.filter("n = 1 and size = 1").select("of.doc_id", "of.hash", "of.first", F.lit(1).cast("long").alias("windows"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["hash"].eqNullSafe(b["hash"])


def _by_text(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return texts.join(found, _same(texts, found), how).drop(found["doc_id"]).drop(found["hash"])


def _repeated_keys(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that come more than once, with their number ``n``: those of up to
    ``most`` rows a key, and those of more.  There is at most one of the latter keys for
    every ``most`` rows; they are broadcast, so that their rows never meet in one task."""
    counts = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key-counts")
    frequent = F.broadcast(counts.filter(F.col("n") > most))
    few = rows.join(frequent, "key", "left_anti").join(counts.filter(F.col("n") <= most), "key")
    return few, rows.join(frequent, "key")


def repeats(docs: DataFrame, match: int = MATCH, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, hash, text, hits: packed anchors whose windows may be repeated,
    misses: runs of their windows that are not), one row per row of ``docs``."""
    texts = _identified(docs)
    every = stage(_anchored(texts, match, reach), "anchors")
    few, many = _repeated_keys(every, chunk)
    kept = stage(few.unionByName(many).drop("n"), "shared-anchors")
    groups = kept.groupBy("key", "near").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "hash", "at")).alias("of"))
    groups = stage(groups.select("key", "size", "of.*"), "anchor-groups")
    few, many = _repeated_keys(groups, chunk)

    def misses(some: DataFrame, solve) -> DataFrame:
        found = some.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("key", "size", "at")).alias("found"))
        return solve(_surroundings(_by_text(texts, found, "inner"), match, reach))

    small = misses(few, lambda x: _refined(x, reach, chunk))
    if not many.isEmpty():
        small = small.unionByName(misses(many, lambda x: _counted(x, reach)))
    once = small.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("first", "windows")).alias("misses"))
    hits = kept.groupBy("doc_id", "hash").agg(F.collect_set("at").alias("hits"))
    spans = hits.join(once, _same(hits, once), "left").drop(once["doc_id"]).drop(once["hash"])
    return _by_text(texts, spans, "left")


def _covered(length: int, hits: np.ndarray, misses: list, match: int) -> np.ndarray:
    """True for each byte that a repeated window covers."""
    first, _, windows = _unpacked(hits)
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + windows, -1)
    repeated = np.cumsum(edge) > 0
    for m in misses:
        repeated[m["first"]:m["first"] + m["windows"]] = False
    starts = np.flatnonzero(repeated)
    edge[:] = 0
    edge[starts] += 1
    edge[starts + match] -= 1
    return np.cumsum(edge)[:length] > 0


def dedup(docs: DataFrame, match: int = MATCH, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), one row per row of ``docs``."""
    return _cut(repeats(docs, match, reach, chunk), match, "kept binary", lambda kept: kept)


def digest(docs: DataFrame, match: int = MATCH, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    return _cut(repeats(docs, match, reach, chunk), match, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _cut(found: DataFrame, match: int, last: str, form) -> DataFrame:
    found = found.select("doc_id", "text", "hits", "misses")
    schema = T.StructType([found.schema["doc_id"], *T._parse_datatype_string("n_bytes bigint, n_removed bigint, n_spans bigint, " + last).fields])

    def run(batches):
        kind = pa.binary() if last.endswith("binary") else pa.string()
        for batch in batches:
            out = []
            hits, misses = batch.column(2), batch.column(3)
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                if not hits[i].is_valid:
                    out.append((len(raw), 0, 0, form(raw)))
                    continue
                gone = _covered(len(raw), np.asarray(hits[i].values), misses[i].as_py() or [], match)
                spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((len(raw), int(gone.sum()), spans, form(np.frombuffer(raw, np.uint8)[~gone].tobytes())))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], kind)],
                                             names=schema.names)

    return found.mapInArrow(run, schema)
