"""Near-duplicate groups by a chosen-path set similarity join.

A document's set is its distinct word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased; with fewer words than a shingle the whole sequence is its one shingle).
Two documents are linked if 100 * intersection >= ``percent`` * union; a group is a
connected component.

1. Documents with one set (128-bit signature) are one *class*; only classes are compared.
2. In each of ``trees`` independent trees a class goes down ``depth`` levels: at each
   level its least token, under a hash drawn for the node it stands in, chooses the
   branch.  Two sets part at a level with probability 1 - similarity, so at 0.8 and with
   20 trees of depth 4 a pair meets in no tree with probability 3e-5.
3. Each node compares its classes with one pivot, another one in each tree.  Links are
   confirmed on full sets, and components formed.
4. A class that is in its node's largest component needs no comparison with the rest of
   it.  The others are *open*.  A node with at most ``small`` open classes is compared in
   full: each open class with every class of another component.  A node with more branches
   further, some levels at a time, until its nodes are small (or ``rounds`` are over; then
   they are compared in full at any size).  Each time it starts BRANCHINGS independent
   branchings, so that a pair that met in it meets again: at 0.8, of the pairs that meet in
   large nodes only, one in 17,000 is lost after three rounds (see ``missed``).  So texts
   that share a passage part quickly, a large group of near copies costs a few comparisons
   per member, and no node is cut.
   Pairs whose sets must differ too much are left out by an exact bound: with BITS parity
   bits per set, the bits that differ are at most the tokens that differ.
5. Components are formed anew by the large-star small-star steps.

Nothing is collected: classes, links and components stay in tables.

Defined cases: a document without words is linked with nothing, also not with another
such; a null doc_id comes after all others as a component's smallest, and a component of
null ids alone has the id null; rows that repeat doc_id and text share their results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.common import SPACES, mixed, powers, prefix_sums, runs, stage, text_slices

WORDS = 5
PERCENT = 80
TREES = 20
DEPTH = 4
SMALL = 256
ROUNDS = 3
#: Levels that a large node branches further in a round.
LEVELS = 4
#: Independent branchings that a large node starts in a round.
BRANCHINGS = 6
BITS = 1024
#: Hashes of tokens by nodes that are held at once.
CELLS = 1 << 20
_IS_SPACE = np.array([b in SPACES.encode() for b in range(256)])
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: bytes, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The set of each row as ascending 64-bit hashes."""
    data = data.lower()  # of bytes: A-Z alone
    raw = np.frombuffer(data, np.uint8)
    starts, ends, row = runs(~_IS_SPACE[raw], offsets)
    sums = prefix_sums(raw)
    hashes = mixed((sums[ends] - sums[starts]) * powers(len(raw) + 1)[1][starts])
    factors = powers(words + 1)[0]
    n = max(0, len(hashes) - words + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(words):
        whole += hashes[j:j + n] * factors[j + 1]
    whole = mixed(whole)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        elif b > a:  # salted with the length: no shingle of other lengths equals it
            out.append(mixed(np.sum(hashes[a:b] * factors[1:b - a + 1], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> bytes:
    return np.array([np.bitwise_xor.reduce(mixed(tokens)), np.sum(mixed(tokens * _ODD))], "<u8").tobytes()


def roots(trees: int) -> np.ndarray:
    return mixed(np.arange(1, trees + 1, dtype=np.uint64) * _ODD)


def paths(tokens: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    """The nodes that the set reaches from the given ones, ``depth`` levels down."""
    for _ in range(depth):
        least = ((tokens[None, :] ^ node[:, None]) * _ODD).argmin(axis=1)
        node = mixed(node * _ODD + tokens[least])
    return node.view(np.int64)


def missed(similarity: float, rounds: int, trees: int = TREES, depth: int = DEPTH) -> float:
    """The probability that a pair is never compared whose nodes are all large for so many rounds."""
    met = 1.0  # of a pair that is in one node: the probability that it is compared below
    for _ in range(rounds):
        met = 1 - (1 - similarity ** LEVELS * met) ** BRANCHINGS
    return (1 - similarity ** depth * met) ** trees


def branchings(nodes: np.ndarray) -> np.ndarray:
    """The roots of the branchings that each node starts."""
    return mixed((nodes[:, None] + roots(BRANCHINGS)[None, :]).ravel())


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of BITS hash values, whether an odd number of tokens has it."""
    odd = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"))


def _signed(texts: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, hash, n_shingles, sig, nodes, bits); the last three are null without words."""
    schema = T.StructType([texts.schema["doc_id"], texts.schema["hash"],
                           *T._parse_datatype_string("n_shingles bigint, sig binary, nodes array<bigint>, bits array<bigint>").fields])

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                sets = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([paths(s, roots(trees), depth) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([parities(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=schema.names)

    return texts.mapInArrow(run, schema)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(sig, tokens) from (sig, text)."""
    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([s.astype("<u8").tobytes() for s in shingle_sets(data, offsets, words)], pa.binary())],
                    names=["sig", "tokens"])

    return texts.select("sig", "text").mapInArrow(run, "sig binary, tokens binary")


def _deeper(rows: DataFrame, sets: DataFrame, levels: int) -> DataFrame:
    """(node, sig) some levels further down, in each of the branchings."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                node = np.asarray(batch.column(1)[i].values).view(np.uint64)
                tokens, starts = np.frombuffer(batch.column(2)[i].as_buffer(), "<u8"), branchings(node)
                step = max(1, CELLS // len(tokens))
                down = np.concatenate([paths(tokens, starts[at:at + step], levels) for at in range(0, len(starts), step)])
                yield pa.RecordBatch.from_arrays([pa.array(down), pa.repeat(batch.column(0)[i], len(down))], names=["node", "sig"])

    nodes = rows.groupBy("sig").agg(F.collect_set("node").alias("nodes"))
    return nodes.join(sets, "sig").select("sig", "nodes", "tokens").mapInArrow(run, "node bigint, sig binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked on full sets."""
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            linked = []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(c[i].as_buffer(), "<u8") for c in (x, y))
                common = len(s) + len(t) - len(np.union1d(s, t)) if percent * max(len(s), len(t)) <= 100 * min(len(s), len(t)) else 0
                linked.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(sig, comp) of every end of a link (a, b): comp is the least sig of its component.

    Large star: the larger neighbours of each end go to its least one.  Small star: so do
    the smaller ones.  Done when the edges, as a whole, stay the same."""
    def known(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()

    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), "links")
    was = None
    while was != (now := known(edges)):
        was = now
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.distinct(), "links")
    return edges.groupBy(F.col("u").alias("sig")).agg(F.min("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("sig"), F.col("v").alias("comp")).distinct())


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH,
           small: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, hash (of the text), n_shingles, component_id and
    ``first`` (doc_id and hash of the one row that stays for the group)."""
    texts = _identified(docs)
    signed = stage(_signed(texts, words, trees, depth), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    classes = stage(signed.filter("sig is not null").groupBy("sig").agg(F.min(F.struct(order.alias("of"), "n_shingles", "nodes", "bits")).alias("x"))
                    .select("sig", "x.*"), "classes")
    placed = classes.select("sig", F.explode("nodes").alias("node"))
    pivot = F.min(F.struct(F.xxhash64("node", "sig").alias("h"), "sig")).alias("pivot")
    shared = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), pivot).filter("n > 1").select("node", "pivot.sig")
    members = stage(placed.join(shared.withColumnRenamed("sig", "pivot"), "node"), "nodes")
    pairs = lambda rows, x, y: rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a != b").distinct()
    first = stage(pairs(members, "sig", "pivot"), "pairs")
    wanted = members.select("sig").distinct().join(classes, "sig").select("sig", "of.doc_id", "of.hash")
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & texts["hash"].eqNullSafe(wanted["hash"])).select("sig", "text")
    sets = stage(_sets(found.dropDuplicates(["sig"]), words), "sets")
    links = stage(_confirmed(first, sets, percent), "links")

    comps = components(links)
    marks = classes.select("sig", F.col("n_shingles").alias("n"), "bits")
    rows, found = members.select("node", "sig"), None
    for left in range(rounds, -1, -1):
        rows = stage(rows.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "labelled")
        sizes = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
        nodes = (sizes.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("x"))
                 .select("node", F.col("x.comp").alias("top"), (F.col("n") - F.col("x.n")).alias("open")).filter("open > 0"))
        full = rows.join(nodes.filter(F.col("open") <= small) if left else nodes, "node").join(marks, "sig")
        rest = full.filter("comp != top").select("node", *(F.col(c).alias(f"rest_{c}") for c in ("sig", "comp", "n", "bits")))
        differ = sum(F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("rest_bits", F.lit(i)))) for i in range(BITS // 64))
        near = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("rest_n"))
        cross = pairs(full.join(rest, "node").filter(F.col("comp") != F.col("rest_comp")).filter(near), "sig", "rest_sig")
        found = cross if found is None else found.unionByName(cross)
        if not left or (large := nodes.filter(F.col("open") > small)).isEmpty():
            break
        rows = _deeper(rows.join(large.select("node"), "node", "left_semi").select("node", "sig"), sets, LEVELS)
    second = stage(found.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        links = links.unionByName(stage(_confirmed(second, sets, percent), "links"))
        comps = components(links)

    classes = classes.select("sig", "of").join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    least = classes.groupBy("comp").agg(F.min("of").alias("first"))
    named = classes.select("sig", "comp").join(least, "comp").select("sig", "first")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    return (signed.select("doc_id", "hash", "n_shingles", "sig").join(named, "sig", "left")
            .withColumn("first", F.coalesce("first", own)).drop("sig").withColumn("component_id", F.col("first.doc_id")))


def digest(docs: DataFrame, words: int = 2) -> DataFrame:
    return groups(docs, words).select("doc_id", "n_shingles", "component_id",
                                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` but one only of each group, that of the smallest doc_id."""
    whole = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stays = groups(docs, words).filter(F.col("hash") == F.col("first.hash")).filter(
        F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "hash").distinct()
    same = whole["doc_id"].eqNullSafe(stays["doc_id"]) & whole["hash"].eqNullSafe(stays["hash"])
    return whole.join(stays, same, "left_semi").dropDuplicates(["doc_id", "hash"]).select("row.*")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w
  FROM documents),
s AS (
  SELECT DISTINCT k, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS t
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w), 2))) AS p) WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
common AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM s x JOIN s y USING (t) GROUP BY ALL HAVING x.k != y.k),
links AS (
  SELECT a, b FROM common JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT k AS a, k AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS k, min(d.doc_id) AS component_id FROM reach JOIN d ON d.k = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN comp USING (k) LEFT JOIN n USING (k)
"""
