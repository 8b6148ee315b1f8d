"""Exact dedup by content sort, in DataFrame operations only.

The order of the sort is (first characters of the normalised text, its 64-bit
hash, the normalised text): equal texts are neighbours, and the first two parts
are a short key whose splitters Spark samples (``repartitionByRange``).  Within
a range the external sort places equal texts side by side, and the window
compares neighbours in full.

A text that holds more than a fraction of a range (found in a sample, so only
the placement depends on it) would land in one task.  Such texts leave the sort:
of them only ids, lengths and hashes are shuffled, dealt by all three, and the
short table of results is joined back to those.

Defined cases: a null text is an empty one and all empty texts are equal; of rows
that agree in length and doc_id too, one stays; a null doc_id
comes after all others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import SPACES

#: Characters of the normalised text in the sort key.
KEY_CHARS = 48
#: Sampled rows per range, and how many of them make a text a hot one.
SAMPLE_PER_RANGE = 16
HOT_SAMPLES = 8


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"),
                       F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_points"))
    return rows.withColumn("key", F.concat(F.substring("norm", 1, KEY_CHARS), F.lit("\n"),
                                           F.hex(F.xxhash64("norm"))))


def hot_keys(docs: DataFrame) -> list[str]:
    """Sort keys with about half a range or more of the rows; at most
    SAMPLE_PER_RANGE / HOT_SAMPLES of them per range, of under 70 characters."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    if not rows:
        return []
    fraction = min(1.0, SAMPLE_PER_RANGE * ranges / rows)
    sample = _keyed(docs.select("doc_id", "text").sample(False, fraction, 7))
    found = sample.groupBy("key").count().filter(F.col("count") >= HOT_SAMPLES)
    return [r["key"] for r in found.select("key").collect()]


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept, text_sha256.
    Of equal texts the row with most code points, then the smallest doc_id, stays."""
    columns = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    rows = _keyed(docs)
    hot = hot_keys(docs)
    cold = rows.filter(~F.col("key").isin(hot)) if hot else rows
    same = Window.partitionBy("key", "norm")
    first = same.orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"))
    cold = (cold.repartitionByRange("key")
            .withColumn("kept", F.row_number().over(first) == 1).withColumn("keep_id", F.first("doc_id").over(first))
            .withColumn("group_size", F.count(F.lit(1)).over(same))
            .withColumn("sha", F.sha2(F.col("norm"), 256))).select(*columns)
    if not hot:
        return cold
    # rows that repeat a doc_id and length are counted, so that one of them can stay
    hot_rows = (rows.filter(F.col("key").isin(hot)).withColumn("sha", F.sha2(F.col("norm"), 256))
                .groupBy("key", "sha", "doc_id", "n_points").agg(F.count(F.lit(1)).alias("copies")))
    best = F.min(F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    totals = hot_rows.groupBy("key", "sha").agg(best.alias("best"), F.sum("copies").alias("group_size"))
    # as many totals as there are hot keys
    decided = hot_rows.join(F.broadcast(totals), ["key", "sha"])
    of_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_points") == -F.col("best.fewer"))
    decided = (decided.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
               .withColumn("kept", of_best & (F.col("copy") == 1)).withColumn("keep_id", F.col("best.doc_id")))
    return cold.unionByName(decided.select(*columns))


SQL = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
         length(coalesce(text, '')) AS n_points
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM rows
WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)
"""
