"""Mixing sources to target weights by systematic sampling, in DataFrame
operations only.

Every document of a source has the same expected number of copies, the source's
rate (target / size, at most ``max_repeat``).  Documents of a source are put in
order of size; the prefix sum of expected copies at place r is rate * r.  One
offset per source, drawn from a hash of its name, is added, and a document is
emitted once per integer that its step of the prefix sum crosses.  As neighbours
in the order have like sizes, the words taken stay within about one long
document of the target.

The places are found without bringing a source together: documents are counted
by (source, size to six binary digits, hash of doc_id); prefix sums over those
short tables give every cell its first place, and rows are numbered only within
their cell.

Defined cases: null or blank text has size 0 and is taken with 0 words; sources
go by code point, a null source last and apart from ''; rows that repeat a doc_id
are documents of their own; a source of size 0 has target 0; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import stage

SEED = "mix-1"
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_cells(docs: DataFrame) -> DataFrame:
    """Adds mix_source (never null), mix_size, and the cell columns mix_class, mix_salt."""
    source = F.col("source")
    digits = F.greatest(F.length(F.bin("mix_size")) - 6, F.lit(0))
    return (docs.withColumn("mix_source", F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source)))
            .withColumn("mix_size", word_count(F.col("text")))
            .withColumn("mix_class", F.call_function("shiftright", F.col("mix_size"), digits) *
                        F.call_function("shiftleft", F.lit(1).cast("long"), digits))
            .withColumn("mix_salt", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source_size, target, mix_rate, mix_offset.

    Sources weigh ``weights`` in turn and share the sum of all sizes; a target
    above max_repeat times its source's size stops there and the excess is
    shared again.  In the order of cap by weight the sources that stop are the
    first ones, so one pass of running sums finds them."""
    sources = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    by_name, everything = Window.orderBy("mix_source"), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    cap = F.col("cap")
    before = Window.orderBy(cap / F.col("weight"), "mix_source").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sources = (sources.withColumn("cap", F.col("source_size") * max_repeat)
               .withColumn("words", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), none))
               .withColumn("shares", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none))
               .withColumn("stops", cap.cast("double") * F.col("shares") <= F.col("weight").cast("double") * F.col("words")))
    free = ~F.col("stops")
    sources = (sources.withColumn("words", F.max(F.when(free, F.col("words"))).over(everything))
               .withColumn("shares", F.max(F.when(free, F.col("shares"))).over(everything)))
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("words").cast("double") / F.col("shares").cast("double"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.col("mix_source"))), 1, 8), 16, 10)
    return (sources.withColumn("target", target)
            .select("mix_source", "source_size", "target",
                    F.when(F.col("stops"), F.lit(float(max_repeat)))
                    .otherwise(F.col("target") / F.col("source_size")).alias("mix_rate"),
                    (hashed.cast("double") / F.lit(2.0 ** 32)).alias("mix_offset")))


def sample(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with mix_size, source_size,
    target and mix_copies; the text is read twice and shuffled only if kept.
    Column names that begin with mix_ and the two named here are taken."""
    rows = with_cells(docs)
    return _sampled(rows, stage(rows.select("mix_source", "mix_size", "mix_class", "mix_salt"), "mix"), weights, max_repeat)


def _sampled(rows: DataFrame, counted: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    cell = ["mix_source", "mix_class", "mix_salt"]
    cells = counted.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("mix_source", "mix_class").agg(F.sum("n").alias("n"))
    by_class = Window.partitionBy("mix_source").orderBy("mix_class")
    by_salt = Window.partitionBy("mix_source", "mix_class").orderBy("mix_salt")
    classes = classes.select("mix_source", "mix_class", (F.sum("n").over(by_class) - F.col("n")).alias("mix_before"))
    cells = cells.select(*cell, (F.sum("n").over(by_salt) - F.col("n")).alias("mix_first"))
    starts = (cells.join(classes, ["mix_source", "mix_class"]).join(targets(counted, weights, max_repeat), "mix_source")
              .withColumn("mix_first", F.col("mix_first") + F.col("mix_before")).drop("mix_before"))
    place = Window.partitionBy(*cell).orderBy("mix_size", F.col("doc_id").asc_nulls_last())
    at = (F.col("mix_first") + F.row_number().over(place)).cast("double")
    edge = lambda r: F.floor(F.col("mix_rate") * r + F.col("mix_offset"))
    return (rows.join(starts, cell)
            .withColumn("mix_copies", F.least(edge(at) - edge(at - 1), F.lit(max_repeat)).cast("int"))
            .withColumn("mix_copies", F.coalesce(F.col("mix_copies"), F.lit(0)))
            .drop("mix_first", "mix_rate", "mix_offset", "mix_class", "mix_salt", "mix_source"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    wanted = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in wanted]).alias("mix_row")
    taken = sample(docs.select("doc_id", "text", "source", whole), weights, max_repeat)
    return (taken.filter("mix_copies > 0")
            .select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
            .select("mix_row.*"))


def taken(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, size, source_size, target, taken (words)."""
    rows = stage(with_cells(docs.select("doc_id", "text", "source")).drop("text", "source"), "mix")
    return _sampled(rows, rows, (1, 2, 3), MAX_REPEAT).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt
  FROM documents),
celled AS (
  SELECT *, (size >> greatest(length(bin(size)) - 6, 0)) << greatest(length(bin(size)) - 6, 0) AS class FROM sized),
sources AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::BIGINT AS weight
  FROM celled GROUP BY src),
ordered AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS words,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shares
  FROM sources
  WINDOW b AS (ORDER BY 3 * source_size / weight::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, cap::DOUBLE * shares <= weight::DOUBLE * words AS stops FROM ordered),
aims AS (
  SELECT src, source_size, stops,
         CASE WHEN stops THEN cap::DOUBLE
              ELSE weight::DOUBLE * (max(CASE WHEN NOT stops THEN words END) OVER ())::DOUBLE
                   / (max(CASE WHEN NOT stops THEN shares END) OVER ())::DOUBLE END AS target,
         ('0x' || substr(md5('mix-1' || src), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM stopped),
placed AS (
  SELECT c.doc_id, c.size, a.source_size, a.target, a.u,
         CASE WHEN a.stops THEN 3.0::DOUBLE ELSE a.target / a.source_size END AS rate,
         (row_number() OVER (PARTITION BY c.src ORDER BY c.class, c.salt, c.size, c.doc_id))::DOUBLE AS r
  FROM celled c JOIN aims a USING (src))
SELECT doc_id, size, source_size, target,
       (coalesce(least(floor(rate * r + u) - floor(rate * (r - 1) + u), 3), 0) * size)::BIGINT AS taken
FROM placed
"""
