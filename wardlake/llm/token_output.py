"""Token-ID output in compressed blocks, and the reader of those files.

Files under the output folder, each a Parquet table (so any store that Spark
writes will do):

- ``frequencies``: (id, frequency) of every id that occurs; frequencies sum to 2^20.
  All blocks share this table.
- ``blocks``: one row per block.  A block holds the ids of whole documents that
  follow each other (about BLOCK_IDS ids; a longer document makes a block of its own),
  coded by a static range asymmetric numeral system with LANES interleaved 64-bit
  states.  Id number i of a block belongs to lane i % LANES; one step pops an id from
  each lane, then every lane below 2^31 takes the next 32-bit word.  A block starts
  from its own states, so blocks decode in any order; ``checkpoints`` repeats the
  states and the word position after every CHECK_STEPS steps, so a long block can be
  entered in the middle.  Checksums: CRC-32 of the words, and of the decoded ids as
  little-endian 32-bit integers.

Documents are in ascending doc_id order (shard, then place in the shard).  Ids are
those of the tokenizer without special tokens, then the end id.

Tokenizing: this tokenizer's pre-tokens never span ASCII white space, nor the border
between an ASCII letter and another ASCII sign than an apostrophe, and it ignores case.
So a text's ids are those of the pieces between such borders in turn, and each distinct
piece of a slice of text goes through the tokenizer once.  (Capitals before a non-ASCII
character stay, as a mark may join them; text that spells a special token is cut at
white space only.)

Defined cases: null and blank texts have the end id only; a null doc_id comes first;
rows that repeat a doc_id are written one after the other, in the order of a hash of
their texts; an empty table writes an empty file and reads no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.common import SPACES, row_of, runs, stage, text_slices
from wardlake.session import scratch_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SCALE_BITS = 20
LANES = 512
BLOCK_IDS = 1 << 19
CHECK_STEPS = 512
#: Pieces of text whose ids a Python worker remembers.
CACHED_PIECES = 600_000
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_WORD_MASK = np.uint64((1 << 32) - 1)
_SCALE = np.uint64(SCALE_BITS)
_SLOT_MASK = np.uint64((1 << SCALE_BITS) - 1)
_SPACE_BYTES = SPACES.encode()
_IS_SPACE = np.array([b in _SPACE_BYTES for b in range(256)])
#: 0 white space, 1 ASCII letter, 2 ASCII sign but the apostrophe, 3 other: a text may be cut between 1 and 2.
_KIND = np.array([0 if b in _SPACE_BYTES else 3 if b == 39 or b > 127 else 1 if chr(b).isalpha() else 2 for b in range(256)], np.uint8)
#: Byte-level tokenizers write printable Latin-1 bytes as themselves, others in order from U+0100.
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_ALPHABET = {b: chr(b) for b in _PLAIN_BYTES} | {
    b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN_BYTES)))}


def _is_word(piece: bytes) -> bool:
    """Small Latin letters below U+0180 only, in composed form."""
    if piece.isascii():
        return piece.isalpha() and piece.islower()
    text = piece.decode()
    return text.isalpha() and max(text) < "\u0180" and text.lower() == text and is_normalized("NFC", text)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokenize:
    """(bytes, offsets) -> ids of all rows, each row closed by the end id; rows' id counts.

    Pieces of small Latin letters alone are one pre-token each, so they go to the
    tokenizer's model as ready words (their bytes spelled in its byte alphabet), and the
    ids that end a word part them again."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.plain_words = bool(suffix) and all(c in vocabulary and c + suffix in vocabulary for c in _BYTE_ALPHABET.values())
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def remember(self, pieces: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat[:self.used], flat, np.zeros(self.used + len(flat), np.int32)))
        else:
            self.flat[self.used:self.used + len(flat)] = flat
        first = self.used + np.cumsum(lengths) - lengths
        self.first, self.length = np.concatenate((self.first, first)), np.concatenate((self.length, lengths))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.used += len(flat)

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece's ids stand in ``first`` and ``length``."""
        if len(self.known) + len(pieces) > CACHED_PIECES:
            self.forget()
        places = list(map(self.known.get, pieces))
        unknown = [i for i, place in enumerate(places) if place is None]
        if not unknown:
            return np.array(places, np.int64)
        new = [pieces[i] for i in unknown]
        words = [t for t in new if _is_word(t)] if self.plain_words else []
        if words:
            flat = np.array(self.words.encode_batch_fast(
                [[t.decode("latin-1").translate(_BYTE_ALPHABET) for t in words]],
                is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[flat]) + 1
            self.remember(words, flat, np.diff(ends, prepend=0))
        rest = [t for t in new if t not in self.known]
        if rest:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in rest], add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.remember(rest, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths)
        for i, t in zip(unknown, new, strict=True):
            places[i] = self.known[t]
        return np.array(places, np.int64)

    def cut(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Starts, ends and rows of the pieces, and the text with its case levelled."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) < 2 or any(t in data for t in self.special):
            return *runs(~_IS_SPACE[raw], offsets), data
        kind = _KIND[raw]
        border = kind[1:] * kind[:-1] == 2
        border |= kind[1:] * kind[:-1] == 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        edge[1:-1] |= border
        some = kind != 0
        starts = np.flatnonzero(some & edge[:-1])
        ends = np.flatnonzero(some & edge[1:]) + 1
        low = np.frombuffer(bytearray(data.lower()), np.uint8)
        kept = np.flatnonzero(raw[1:] >= 128)
        kept = kept[low[kept] != raw[kept]]
        low[kept] = raw[kept]
        return starts, ends, row_of(starts, offsets), low.tobytes()

    def __call__(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        starts, ends, row, data = self.cut(data, offsets)
        bounds = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.translate(None, _SPACE_BYTES))])
        coded = words.dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        count = self.length[place]
        before = np.cumsum(count) - count
        of_row = np.bincount(row, weights=count, minlength=rows).astype(np.int64) + 1
        out = np.full(int(of_row.sum()), self.end_id, np.int32)
        # a piece's ids go to where they stand among all ids, plus an end id per earlier row
        step = np.arange(int(count.sum()))
        out[step + np.repeat(row, count)] = self.flat[step + np.repeat(self.first[place] - before, count)]
        return out, of_row


class Coder:
    """The block code for one frequency table."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.frequency = np.zeros(size, np.uint64)
        self.frequency[ids] = frequencies
        self.start = np.cumsum(self.frequency) - self.frequency
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.frequency.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """(words, first states, checkpoints)"""
        f, c = self.frequency[ids], self.start[ids]
        steps = -(-len(ids) // LANES)
        states = np.full(LANES, _LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for t in range(steps - 1, -1, -1):
            if (t + 1) % CHECK_STEPS == 0 and t + 1 < steps:
                marks.append((written, states.copy()))
            ft, ct = f[t * LANES:(t + 1) * LANES], c[t * LANES:(t + 1) * LANES]
            x = states[:len(ft)]
            over = x >= ft << np.uint64(63 - SCALE_BITS)
            out = x[over]
            if len(out):
                words.append((out & _WORD_MASK).astype("<u4"))
                written += len(out)
                x = np.where(over, x >> _WORD, x)
            q = x // ft
            states[:len(ft)] = (q << _SCALE) + (x - q * ft) + ct
        checkpoints = b"".join(np.uint64(written - at).astype("<u8").tobytes() + s.astype("<u8").tobytes() for at, s in reversed(marks))
        stream = np.concatenate(words[::-1]).tobytes() if words else b""
        return stream, states.astype("<u8").tobytes(), checkpoints

    def decode(self, words: bytes, states: bytes, n_ids: int, checkpoints: bytes = b"", part: int = 0) -> np.ndarray:
        """All ids, or those from checkpoint number ``part`` (1 is the first) to the end."""
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        at = 0
        if part:
            record = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)[part - 1]
            at, x, n_ids = int(record[0]), record[1:].astype(np.uint64), n_ids - part * CHECK_STEPS * LANES
        else:
            x = np.frombuffer(states, "<u8").astype(np.uint64)
        out = np.empty(n_ids, np.uint32)
        for first in range(0, n_ids, LANES):
            k = min(LANES, n_ids - first)
            y = x[:k]
            slot = y & _SLOT_MASK
            ids = self.symbol[slot]
            out[first:first + k] = ids
            y = self.frequency[ids] * (y >> _SCALE) + slot - self.start[ids]
            low = np.flatnonzero(y < _LOW)
            if len(low):
                y[low] = (y[low] << _WORD) | stream[at:at + len(low)]
                at += len(low)
            x[:k] = y
        return out


def scaled(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts brought to a sum of 2^SCALE_BITS, each at least 1."""
    room = (1 << SCALE_BITS) - len(ids)
    out = 1 + np.floor(counts.astype(np.float64) * (room / max(1.0, float(counts.sum(dtype=np.float64))))).astype(np.int64)
    out[np.argmax(counts)] += (1 << SCALE_BITS) - int(out.sum())
    return out


#: Text that is encoded at once: a piece is looked up once for all of it.
TOKEN_BYTES = 1 << 22

_READY: dict[tuple[str, int], Tokenize] = {}


def tokenize(path: str, end_id: int) -> Tokenize:
    """One per Python worker, with the pieces that it knows already."""
    if (path, end_id) not in _READY:
        _READY[path, end_id] = Tokenize(path, end_id)
    return _READY[path, end_id]


def id_kind(path: str | None = None) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path or tokenizer_path()).get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(shard, place, doc_id, n_tokens, ids as little-endian 16- or 32-bit integers),
    sharded and sorted by ascending doc_id, then a hash of the text."""
    path = path or tokenizer_path()
    kind = id_kind(path)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType()),
                           rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    names = schema.names

    def run(batches):
        shard, place = TaskContext.get().partitionId(), 0
        encode = tokenize(path, end_id)
        for batch in batches:
            for part, data, offsets in text_slices(batch, limit=TOKEN_BYTES):
                ids, counts = encode(data, offsets)
                n = len(counts)
                ends = np.concatenate(([0], np.cumsum(counts) * np.dtype(kind).itemsize)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(place, place + n)), part.column(0),
                    pa.array(counts), pa.Array.from_buffers(pa.binary(), n, [
                        None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind).tobytes())])], names=names)
                place += n

    return rows.mapInArrow(run, schema)


def _counted(tokens: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(found) > len(total):
                    total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
                total[:len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every text of ``docs`` under ``folder`` in the format above."""
    spark = docs.sparkSession
    kind = id_kind(path)
    tokens = stage(tokenized(docs, path, end_id), "tokens")
    # at most one row per id of the vocabulary
    table = sorted((r["id"], r["n"]) for r in _counted(tokens, kind).collect())
    ids = np.array([i for i, _ in table], np.int64)
    frequencies = scaled(ids, np.array([n for _, n in table], np.int64)) if table else ids
    (spark.createDataFrame(list(zip(ids.tolist(), frequencies.tolist(), strict=True)), "id int, frequency int")
     .coalesce(1).write.parquet(f"{folder}/frequencies"))
    shared = spark.sparkContext.broadcast((ids, frequencies))
    doc_id = tokens.schema["doc_id"]
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(doc_id.dataType)), T.StructField("n_tokens", T.ArrayType(T.LongType())),
        *(T.StructField(n, T.BinaryType()) for n in ("words", "states", "checkpoints")),
        T.StructField("words_crc32", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        coder = Coder(*shared.value)
        held: list[tuple] = []
        size = 0

        def block():
            ids = np.frombuffer(b"".join(h[4] for h in held), kind)
            words, states, checkpoints = coder.encode(ids)
            return pa.RecordBatch.from_pylist([{
                "shard": held[0][0], "place": held[0][1], "n_ids": size, "doc_ids": [h[2] for h in held],
                "n_tokens": [h[3] for h in held], "words": words, "states": states, "checkpoints": checkpoints,
                "words_crc32": zlib.crc32(words), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}], schema=target)

        target = None
        for batch in batches:
            if target is None:
                b, long = pa.binary(), pa.int64()
                target = pa.schema([("shard", pa.int32()), ("place", long), ("n_ids", long), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)),
                                    ("n_tokens", pa.list_(long)), ("words", b), ("states", b), ("checkpoints", b), ("words_crc32", long), ("ids_crc32", long)])
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for row in zip(*columns, strict=True):
                if held and (row[:2] != (held[-1][0], held[-1][1] + 1) or size + row[3] > BLOCK_IDS):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield block()

    tokens.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, place) of every document, from the files."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    table = spark.read.parquet(f"{folder}/frequencies").collect()  # one row per id of the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in table], np.int64), np.array([r["frequency"] for r in table], np.int64)))
    doc_id = T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType()), doc_id,
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        coder = Coder(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                b = {n: batch.column(n)[i] for n in batch.schema.names}
                words = b["words"].as_py()
                if zlib.crc32(words) != b["words_crc32"].as_py():
                    raise ValueError(f"block {b['shard']}/{b['place']}: its words are damaged")
                data = coder.decode(words, b["states"].as_py(), b["n_ids"].as_py()).astype("<u4").tobytes()
                if zlib.crc32(data) != b["ids_crc32"].as_py():
                    raise ValueError(f"block {b['shard']}/{b['place']}: its ids are damaged")
                counts = np.asarray(b["n_tokens"].values)
                ends = np.cumsum(counts) * 4
                n = len(counts)
                place = b["place"].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, b["shard"].as_py(), np.int32)), pa.array(np.arange(place, place + n)), b["doc_ids"].values,
                    pa.array(counts), pa.array([zlib.crc32(data[e - 4 * k:e]) for e, k in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64())],
                    names=schema.names)

    rows = blocks.select("shard", "place", "doc_ids", "n_tokens", "n_ids", "words", "states", "words_crc32", "ids_crc32").mapInArrow(run, schema)
    # the ids before a shard: a running sum over one row per shard; within it, over its documents
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place")) - F.col("n_tokens")
    return (rows.join(shards, "shard").withColumn("start", F.col("base") + inside)
            .select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"))


def output(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``docs`` and read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark, 'llm')}/token-output-{uuid.uuid4().hex}"
    write_tokens(docs, folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
