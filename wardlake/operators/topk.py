"""Grouped counting and top-k helpers.

``top_k_per_group`` uses ``row_number() <= k`` over a window; Spark plans it
as a partial ``WindowGroupLimit`` *before* the shuffle, so each map task
forwards at most k rows per group and a hot group costs no more than a cold
one after the exchange.  ``count_top`` is a partial+final hash aggregate and,
with a limit, a ``TakeOrderedAndProject`` (per-partition top-n, n rows to the
driver).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_top(df: DataFrame, keys: Sequence[str], n: int | None = None, keep_null: bool = False,
              count_name: str = "count") -> DataFrame:
    """Group by ``keys`` and count; order by count desc then keys (nulls first).

    keep_null=False drops rows whose first key is null before counting (SQL
    form of the dashboard); keep_null=True keeps null as its own group
    (lake form).
    """
    src = df.select(*keys)
    if not keep_null:
        src = src.filter(F.col(keys[0]).isNotNull())
    out = src.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    out = out.orderBy(F.desc(count_name), *[F.asc_nulls_first(k) for k in keys])
    return out if n is None else out.limit(n)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank_name: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group under ``order`` (which must be
    a total order, i.e. end with a unique key) and number them 1..k."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)
