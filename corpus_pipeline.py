"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read
again before the next.

1. ``language_id``: documents without a language (no letter) go.
2. ``near_dedup``: one document of each near-duplicate group (five-word shingles,
   similarity 0.8) stays, that of the smallest doc_id.
3. ``decontaminate``: documents that hold a window of ``benchmark`` go.
4. ``mix``: documents are taken as often as the target weights of their sources ask.
5. ``token_output``: token ids are written and read back; one row per document taken.

All but the last return the columns of ``documents``.  SQL cannot express the stages
(a trained classifier, the tokenizer); tests compare them with brute-force versions.
Null, empty and repeated rows: as the operators define them; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlake.llm import decontaminate, language_id, minhash_dedup, mixing, token_output
from wardlake.llm.common import stage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.output(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
