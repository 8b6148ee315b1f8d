"""Stores that grow by batches (A8, A9) and keyed tables merged in place.

A store is a folder of Parquet tables; reports and chat rows have one partition per
batch.  A batch that the store holds is not saved again, and a batch is written by
overwriting its own partition, so saving one twice, or again after a run that was lost
on the way, adds nothing.  Patients are looked up by name before they are created: what
a lost run had created is found.  One writer at a time.

A keyed table is partitioned by a hash of its key.  A merge reads and rewrites only the
partitions that its updates fall into; the merged rows are staged under the shared
checkpoint folder first, so that no plan reads what it overwrites, and a merge that was
lost can be run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.session import write_table
from wardlake.sources.lake import dense_index, upsert_by_key, upsert_patients



def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in text.split(", "))])


PATIENTS = _schema("id long, name string, location string, medical_history string")
REPORTS = _schema(
    "save_id long, patient_id long, patient_name string, hospital string, symptoms string, disease string, "
    "specialty string, risk_score int, priority string, recommendation string, details string, "
    "generated_at string, batch string")
CHATS = _schema(
    "patient_id long, session_id string, turn long, message string, reply string, timestamp string, batch string")


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(rows: DataFrame, path: str, schema: T.StructType, batch: str) -> bool:
    typed = rows.withColumn("batch", F.lit(batch)).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    (typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
    return True


def _holds(spark: SparkSession, path: str, schema: T.StructType, batch: str) -> bool:
    return not stored(spark, path, schema).filter(F.col("batch") == batch).isEmpty()


def patient_name(name: Column) -> Column:
    """A missing or empty name is the unnamed patient's."""
    return F.coalesce(C.nonblank(name), F.lit(K.DEFAULT_PATIENT))


def get_or_create_patients(names: DataFrame, store: str) -> DataFrame:
    """(name, patient_id) of all patients, after those of ``names`` (a column ``name``)
    that the store lacks have been created, in name order, with ids after its greatest.
    Of several patients with one name the first (least id) counts."""
    spark, path = names.sparkSession, f"{store}/patients"
    known = stored(spark, path, PATIENTS)
    new = names.select(patient_name(F.col("name")).alias("name")).distinct().join(known.select("name"), "name", "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    created = dense_index(new, ["name"], "id", last)
    created.select("id", "name", *[F.lit(None).cast("string").alias(c) for c in ("location", "medical_history")]).write.mode("append").parquet(path)
    return stored(spark, path, PATIENTS).groupBy("name").agg(F.min("id").alias("patient_id"))


def save_reports(saves: DataFrame, store: str, batch: str) -> bool:
    """Append the reports ``saves`` (save_id, patient_name, hospital, symptoms, specialty,
    risk_score, priority, recommendation, generated_at and ``details``, a struct or map of
    the caller's own; null is an empty one) with their patients' ids, the disease inferred
    from the symptoms, and the details as JSON.  False, and nothing done, if the store
    holds the batch."""
    path = f"{store}/reports"
    if _holds(saves.sparkSession, path, REPORTS, batch):
        return False
    ids = get_or_create_patients(saves.select(F.col("patient_name").alias("name")), store)
    rows = (saves.withColumn("patient_name", patient_name(F.col("patient_name")))
            .join(ids.withColumnRenamed("name", "patient_name"), "patient_name")
            .withColumn("disease", C.infer_disease(F.col("symptoms"), F.col("specialty")))
            .withColumn("details", F.coalesce(F.to_json("details", {"ignoreNullFields": "false"}), F.lit("{}"))))
    return _append(rows, path, REPORTS, batch)


def chat_reply(response: Column, fields: list[str]) -> Column:
    """The reply of a response struct, or where it has no text the JSON of its fields
    without the bulky ones (nulls are written)."""
    kept = F.struct(*[response[f].alias(f) for f in fields if f not in K.CHAT_DROPPED_FIELDS])
    rest = F.to_json(kept, {"ignoreNullFields": "false"})
    return F.coalesce(C.nonblank(response["reply"]), rest) if "reply" in fields else rest


def save_chats(turns: DataFrame, store: str, batch: str) -> bool:
    """Append chat turns (session_id, turn, message, timestamp and the struct ``response``)
    under the unnamed patient; turns without a session are not stored.  False, and nothing
    done, if the store holds the batch."""
    spark, path = turns.sparkSession, f"{store}/chat_history"
    if _holds(spark, path, CHATS, batch):
        return False
    unnamed = spark.createDataFrame([(K.DEFAULT_PATIENT,)], "name string")
    patient = get_or_create_patients(unnamed, store).filter(F.col("name") == K.DEFAULT_PATIENT).first()["patient_id"]
    fields = turns.schema["response"].dataType.names
    rows = turns.filter(C.nonblank(F.col("session_id").cast("string")).isNotNull()).select(
        F.lit(patient).alias("patient_id"), "session_id", "turn", "message",
        chat_reply(F.col("response"), fields).alias("reply"), "timestamp")
    return _append(rows, path, CHATS, batch)


class KeyedTable:
    """A Parquet table under ``path`` with one row per ``key``, dealt into ``parts``
    partitions by the key's hash (so many that one is a comfortable file or a few; fixed
    once the table is written, as is ``schema``)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts
        self.schema = T.StructType([f for f in schema if f.name != "part"])

    def _dealt(self, df: DataFrame) -> DataFrame:
        # like keys must hash alike whatever integer type an update brings
        key = F.col(self.key).cast(self.schema[self.key].dataType)
        return (df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
                .withColumn("part", F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")))

    def _write(self, dealt: DataFrame) -> None:
        (dealt.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("part").parquet(self.path))

    def write(self, df: DataFrame) -> None:
        self._write(self._dealt(df))

    def _parts(self) -> DataFrame:
        return stored(self.spark, self.path, T.StructType([*self.schema, T.StructField("part", T.IntegerType())]))

    def read(self) -> DataFrame:
        return self._parts().drop("part")

    def merge(self, updates: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """Merge ``updates``: ``combine`` gets the rows of the touched partitions and the
        updates and returns the partitions' new rows (by default ``upsert_by_key``).
        Returns the touched partitions, at most ``parts`` numbers."""
        combine = combine or (lambda base, new: upsert_by_key(base, new, self.key))
        new = write_table(self._dealt(updates), "merge-updates")
        touched = sorted(r["part"] for r in new.select("part").distinct().collect())
        if touched:
            base = self._parts().filter(F.col("part").isin(touched)).drop("part")
            self._write(write_table(self._dealt(combine(base, new.drop("part"))), "merge-rows"))
        return touched


def merge_patients(table: KeyedTable, updates: DataFrame) -> list[int]:
    """A10 on a table keyed by ``name``: non-empty fields replace, unknown names are
    created with ids after the greatest of the whole table (only that column is read)."""
    last = table.read().agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    return table.merge(updates.withColumn("id", F.lit(None).cast("long")),
                       lambda base, new: upsert_patients(base, new, last_id=last).drop("is_new"))
