"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame
over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlake.llm import (decontaminate, exact_dedup, hard_negatives, language_id, license_scan, line_dedup, minhash_dedup, mixing,
                          spelling, suffix_dedup, token_counts, token_output, top_k)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@_register("op1_decontamination", decontaminate.SQL)
def op1(spark, sf_dir):
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register("op2_language_id")
def op2(spark, sf_dir):
    return language_id.digest(_table(spark, sf_dir, "documents"))


@_register("op3_suffix_dedup")
def op3(spark, sf_dir):
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


@_register("op4_exact_dedup", exact_dedup.SQL)
def op4(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@_register("op5_token_counts")
def op5(spark, sf_dir):
    return token_counts.digest(_table(spark, sf_dir, "documents"))


@_register("op6_minhash_dedup", minhash_dedup.SQL)
def op6(spark, sf_dir):
    return minhash_dedup.digest(_table(spark, sf_dir, "documents"))


@_register("op7_line_dedup")
def op7(spark, sf_dir):
    return line_dedup.result(_table(spark, sf_dir, "documents"))


@_register("op8_license_scan")
def op8(spark, sf_dir):
    return license_scan.digest(_table(spark, sf_dir, "documents"), license_scan.template_table(spark))


@_register("op9_mixing", mixing.SQL)
def op9(spark, sf_dir):
    return mixing.taken(_table(spark, sf_dir, "documents"))


@_register("op10_token_output")
def op10(spark, sf_dir):
    return token_output.output(_table(spark, sf_dir, "documents"))


@_register("op11_hard_negatives", hard_negatives.SQL)
def op11(spark, sf_dir):
    return hard_negatives.digest(_table(spark, sf_dir, "embeddings"))


@_register("op12_spelling", spelling.SQL)
def op12(spark, sf_dir):
    return spelling.variants(_table(spark, sf_dir, "documents"))


@_register("op13_top_k", top_k.SQL)
def op13(spark, sf_dir):
    return top_k.digest(_table(spark, sf_dir, "embeddings"))
