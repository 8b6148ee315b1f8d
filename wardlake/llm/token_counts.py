"""Edit-aware token counts.

A document's text is cut, before white space, into leaves of about LEAF bytes.  As no
pre-token of the tokenizer spans white space, the count of a text is the sum over its
leaves.  The sums are kept as a segment tree per document: an array with the root at 1,
the children of i at 2i and 2i + 1, and the leaves at the end.

An edit re-encodes the leaves that it touches, and the leaf before where it begins at a
leaf's first byte (its white space may go, or text may join the word before); the sums
above those leaves are updated and no other text is encoded.  The new text of several
touched leaves goes to the first of them, the others become empty.

Defined cases: null counts as empty, with one empty leaf; edits are (start, end, text) in
characters of the text as it was, put in order of start, cut off at the text's end and at
the end of the edit before; null edits change nothing; rows that repeat a doc_id keep
states of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import SPACES, annotate, stage
from wardlake.llm.token_output import END_ID, tokenize, tokenizer_path

LEAF = 256
_IS_SPACE = np.array([b in SPACES.encode() for b in range(256)])
_STATE = "leaves array<int>, tree array<int>"


def leaf_offsets(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Where the leaves of all rows begin, and the end."""
    raw = np.frombuffer(data, np.uint8)
    gap = _IS_SPACE[raw]
    gap[1:] &= ~gap[:-1].copy()
    places = np.flatnonzero(gap)
    if not len(places):
        return np.unique(offsets)
    nearest = np.searchsorted(places, np.arange(LEAF, len(raw), LEAF))
    return np.union1d(offsets, places[nearest[nearest < len(places)]])


def sums(counts: np.ndarray) -> np.ndarray:
    """The tree over the leaves' counts."""
    size = 1 << max(0, int(len(counts) - 1).bit_length())
    tree = np.zeros(2 * size, np.int64)
    tree[size:size + len(counts)] = counts
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def counted(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, all by default), leaves (their bytes), tree (tree[1]: all tokens)."""
    path = path or tokenizer_path()

    def make():
        encode = tokenize(path, END_ID)

        def work(data, offsets):
            bounds = leaf_offsets(data, offsets)
            _, n = encode(data, bounds)
            n = n - 1  # without the end id
            size = np.diff(bounds)
            first = np.searchsorted(bounds, offsets)
            leaves = [size[a:b] if b > a else np.zeros(1, np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            trees = [sums(n[a:b] if b > a else np.zeros(1, np.int64)) for a, b in zip(first[:-1], first[1:], strict=True)]
            kind = pa.list_(pa.int32())
            return pa.array([x.astype(np.int32) for x in leaves], kind), pa.array([x.astype(np.int32) for x in trees], kind)
        return work

    return annotate(docs, docs.columns if keep is None else keep, make, _STATE)


def touched(text: str, leaves: np.ndarray, edits: list) -> tuple[list[tuple[int, int, bytes]], bytes]:
    """Ranges of leaves (first, last) with their new bytes, and the new text."""
    raw = text.encode()
    bounds = np.concatenate(([0], np.cumsum(leaves)))
    ranges: list[list] = []  # first leaf, last leaf, edits in bytes
    changes, last = [], 0
    for start, end, new in sorted((min(max(0, s), len(text)), min(max(0, e), len(text)), t or "") for s, e, t in edits):
        start = max(start, last)
        end = last = max(start, end)
        a = len(text[:start].encode())
        b = a + len(text[start:end].encode())
        i = min(int(np.searchsorted(bounds, a, side="right")) - 1, len(leaves) - 1)
        while i > 0 and bounds[i] == a:
            i -= 1
        j = max(i, int(np.searchsorted(bounds, b, side="left")) - 1)
        changes.append((a, b, new.encode()))
        if ranges and i <= ranges[-1][1]:
            ranges[-1][1] = max(j, ranges[-1][1])
            ranges[-1][2].append(changes[-1])
        else:
            ranges.append([i, j, [changes[-1]]])
    return ([(i, j, edited(raw, int(bounds[i]), int(bounds[j + 1]), some)) for i, j, some in ranges],
            edited(raw, 0, len(raw), changes))


def edited(raw: bytes, first: int, end: int, changes: list) -> bytes:
    out = []
    for a, b, new in changes:
        out += [raw[first:a], new]
        first = b
    return b"".join([*out, raw[first:end]])


def update(tree: np.ndarray, leaf: int, count: int) -> None:
    """Set a leaf's count and the sums above it."""
    at = len(tree) // 2 + leaf
    change = count - tree[at]
    while at and change:
        tree[at] += change
        at //= 2


def apply_edits(state: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """From (text, leaves, tree, edits: array of (start, end, text), the columns ``keep``): those
    columns, the new text, leaves and tree, and the number of leaves and bytes encoded again."""
    path = path or tokenizer_path()
    whole = state.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "leaves", "tree", "edits")
    schema = whole.select("row", "text", "leaves", "tree").schema.add("leaves_encoded", "long").add("bytes_encoded", "long")

    def run(batches):
        encode = tokenize(path, END_ID)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                leaves = [np.array(x, np.int64) for x in part.column(2).to_pylist()]
                trees = [np.array(x, np.int64) for x in part.column(3).to_pylist()]
                texts, changed, encoded, of = part.column(1).to_pylist(), [], [], []
                for i, edits in enumerate(part.column(4).to_pylist()):
                    some, new = touched(texts[i], leaves[i], [tuple(e.values()) for e in edits or [] if e is not None])
                    texts[i] = new.decode()
                    encoded.append((sum(j - k + 1 for k, j, _ in some), sum(len(x) for *_, x in some)))
                    changed += some
                    of += [i] * len(some)
                data = b"".join(x for *_, x in changed)
                _, counts = encode(data, np.concatenate(([0], np.cumsum([len(x) for *_, x in changed], dtype=np.int64))))
                for i, (first, last, new), n in zip(of, changed, counts.tolist(), strict=True):
                    leaves[i][first:last + 1] = 0
                    leaves[i][first] = len(new)
                    update(trees[i], first, n - 1)
                    for k in range(first + 1, last + 1):
                        update(trees[i], k, 0)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(texts, pa.string()), pa.array([x.astype(np.int32) for x in leaves], kind),
                    pa.array([x.astype(np.int32) for x in trees], kind),
                    *(pa.array(x, pa.int64()) for x in (zip(*encoded, strict=True) if encoded else ((), ())))], names=schema.names)

    return whole.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Counts of every document before and after two edits: its source's name and a blank
    put in after a third of its characters, and 50 characters cut out after two thirds."""
    state = counted(docs.select("doc_id", "source", "text"))
    state = stage(state.select("row.*", "leaves", "tree"), "counts")
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    third, two_thirds = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), new.alias("new"))
    edits = F.array(edit(third, third, F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit(" "))),
                    edit(two_thirds, two_thirds + 50, F.lit("")))
    state = state.withColumn("edits", edits).withColumn("before", F.get("tree", F.lit(1)))
    done = apply_edits(state, ["doc_id", "before"])
    return done.select("row.doc_id", F.col("row.before").cast("long").alias("tokens_before"),
                       F.get("tree", F.lit(1)).cast("long").alias("tokens_after"),
                       F.size("leaves").cast("long").alias("n_leaves"), "leaves_encoded", "bytes_encoded")
