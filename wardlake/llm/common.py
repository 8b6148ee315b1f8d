"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.session import scratch_dir

#: ASCII white space of the contracts: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 1 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back:
    lineage ends at files that every executor sees."""
    path = f"{scratch_dir(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Cut a record batch into runs of rows of about ``limit`` bytes of text
    (a longer text makes a run of its own).  Yields (rows, their texts'
    UTF-8 bytes joined, byte offsets of the rows: one more than rows).
    Null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.asarray(pa.compute.binary_length(col), dtype=np.int64))
    at = 0
    while at < len(col):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        offsets = np.concatenate(([0], ends[at:stop] - base))
        part = col.slice(at, stop - at)
        buffers, first = part.buffers(), part.offset
        starts = np.frombuffer(buffers[1], dtype=np.int64)[first:first + 2]
        data = bytes(buffers[2][int(starts[0]):int(starts[0]) + int(offsets[-1])]) if buffers[2] is not None and offsets[-1] else b""
        yield batch.slice(at, stop - at), data, offsets
        at = stop


#: An odd multiplier of 64 bits and its inverse: strings hash as sums of byte * power.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                      for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums s with hash(values[a:b]) = (s[b] - s[a]) * inverse^a."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(len(values))[0], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that end at row bounds: starts, ends, row of each."""
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True  # a row begins here
    begins, closes = edge[:-1].copy(), edge[1:].copy()
    begins[1:] |= ~mask[:-1]
    closes[:-1] |= ~mask[1:]
    begins &= mask
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes & mask) + 1, row_of(starts, offsets)


def row_of(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each of the ascending positions ``at``."""
    before = np.searchsorted(at, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(before))


def annotate(docs: DataFrame, keep: list[str], make, extra: str) -> DataFrame:
    """Column ``row`` (a struct of the columns ``keep``) and the columns of the
    schema string ``extra``, made from whole texts in Arrow batches.  ``make()``
    runs once per task and gives a function (bytes, offsets) -> Arrow arrays.
    Names in ``docs`` cannot clash with those added."""
    slim = docs.select(F.col("text").cast("string").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    schema = T.StructType([slim.schema["row"], *T._parse_datatype_string(extra).fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        work = make()
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(1), *work(data, offsets)], names=names)

    return slim.mapInArrow(run, schema)
