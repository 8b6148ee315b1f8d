"""Lake sources and sinks.

Writes never overwrite a path that the same plan reads: upserts produce a
new table version at a new path, or go through ``wardlake.sources.store``.  Scratch output goes under the shared
``spark.checkpoint.dir`` (see ``wardlake.session.scratch_dir``), never a
machine-local temp folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.functions import clinical as C

# Table schemas of the clinical store (explicit: inference turns all-null
# columns into errors and nullable ints into doubles).
DOCTORS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("hospital", T.StringType()), T.StructField("specialty", T.StringType()),
    T.StructField("experience", T.IntegerType()), T.StructField("available_time", T.StringType()),
    T.StructField("available", T.BooleanType()),
])
# Column defaults used when an older table lacks a column.
DOCTOR_DEFAULTS = {"hospital": "Texas Health Frisco", "experience": 5, "available_time": None, "available": True}

APPOINTMENTS_CSV_SCHEMA = T.StructType([
    T.StructField("patient", T.StringType()), T.StructField("symptoms", T.StringType()),
    T.StructField("specialty", T.StringType()), T.StructField("risk", T.IntegerType()),
    T.StructField("hospital", T.StringType()), T.StructField("doctor", T.StringType()),
    T.StructField("priority", T.StringType()),
])
PATIENTS_CSV_SCHEMA = T.StructType([
    T.StructField("patient", T.StringType()), T.StructField("age", T.IntegerType()),
    T.StructField("chest_pain", T.IntegerType()), T.StructField("diabetes", T.IntegerType()),
    T.StructField("hypertension", T.IntegerType()), T.StructField("shortness_of_breath", T.IntegerType()),
    T.StructField("blood_pressure", T.IntegerType()), T.StructField("risk", T.IntegerType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A1: header CSV with an explicit schema (or inference when none given)."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (source = file name, text = whole file)."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              num_partitions: int, properties: dict | None = None) -> DataFrame:
    """A4: a relational table read in parallel slices of ``partition_column``
    (one query per slice, run by the executors), instead of one driver-side
    read of the whole table."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def append_reports(reports: DataFrame, path: str) -> str:
    """A8 sink: append report rows partitioned by report day, so trend
    queries and the report stream read only the days they need."""
    day = F.coalesce(F.substring("generated_at", 1, 10), F.lit("unknown"))
    return write_table(reports.withColumn("day", F.when(day == "", "unknown").otherwise(day)), path, "append", ["day"])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Parquet sink; optionally partitioned (e.g. by report day)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export_tables(tables: dict[str, DataFrame], base: str) -> DataFrame:
    """A3: write each table as Parquet under ``base``; returns the status rows
    (table, path) — the caller reads the tables back with spark.read."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        write_table(df, path, "overwrite")
        rows.append((name, path))
    return spark.createDataFrame(rows, "table string, path string")


def reconcile(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Bring an older table to ``schema``: missing columns are added
    with their default (or NULL), existing ones cast, order as in schema."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def require_columns(df: DataFrame, columns: list[str], empty_schema: str) -> DataFrame | None:
    """None when all columns exist, else an empty DataFrame of ``empty_schema``."""
    if all(c in df.columns for c in columns):
        return None
    return df.sparkSession.createDataFrame([], empty_schema)


def seed_if_empty(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed rows when the table has none, else the table as is
    (``isEmpty`` reads at most one row)."""
    return seed if existing.isEmpty() else existing


def valid_uploads(uploads: DataFrame, type_col: str = "content_type", size_col: str = "length",
                  allowed=None, max_bytes: int | None = None) -> DataFrame:
    """Uploads with an allowed content type (case-insensitive; a missing
    type is accepted, as the upload check does) and at most ``max_bytes``."""
    from wardlake import constants as K

    allowed = allowed or K.IMAGE_TYPES
    max_bytes = K.IMAGE_MAX_BYTES if max_bytes is None else max_bytes
    t = F.col(type_col)
    return uploads.filter((t.isNull() | F.lower(t).isin(*allowed)) & (F.col(size_col) <= max_bytes))


def upsert_by_key(base: DataFrame, updates: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """A11 (SCD1): rows of ``updates`` replace base rows with the same key;
    new keys are inserted; other base rows are kept.  Of several updates with
    one key the last by ``order`` counts (without it, the greatest row)."""
    kept = base.join(updates.select(key), key, "left_anti")
    row = F.struct(*[F.col(c) for c in base.columns])
    rank = F.struct(F.col(order), row) if order else row
    last = updates.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, rank).alias("_row")).select("_row.*")
    return kept.unionByName(last)


def dense_index(df: DataFrame, order: list[str], name: str, start: int) -> DataFrame:
    """Dense numbering start+1, start+2, ... in ``order`` without a
    single-partition window over the rows.  The range-partitioned sort is tagged
    with the partition id and ``monotonically_increasing_id`` (sequential inside
    a partition) and checkpointed to the shared checkpoint dir, so every later
    read sees the same partitions; running sums of the per-partition counts (one
    row per partition) are joined back as offsets."""
    from wardlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    tagged = (df.orderBy(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"))
               .select("_pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(offsets, "_pid")
            .withColumn(name, (F.lit(start) + F.col("_before") + local + 1).cast("long"))
            .drop("_pid", "_mid", "_before"))


def upsert_patients(base: DataFrame, updates: DataFrame, order: str | None = None, last_id: int | None = None) -> DataFrame:
    """A10: match on name.  Existing patients get only the non-empty new
    fields, of several updates the last non-empty one by ``order`` (without it
    the greatest); unknown names are inserted with new ids after the current
    maximum of ``base``, or ``last_id`` if given (in name order).  Output: id, name,
    location, medical_history, is_new."""
    def last(column: str):
        full = C.nonblank(F.col(column)).isNotNull()
        rank = F.struct(F.col(order), F.col(column)) if order else F.col(column)
        return F.coalesce(F.max_by(F.when(full, F.col(column)), F.when(full, rank)), F.max(column))

    u = updates.groupBy("name").agg(last("location").alias("u_loc"), last("medical_history").alias("u_hist"))
    matched = base.join(u, "name", "left").select(
        "id", "name",
        F.coalesce(C.nonblank(F.col("u_loc")), F.col("location")).alias("location"),
        F.coalesce(C.nonblank(F.col("u_hist")), F.col("medical_history")).alias("medical_history"),
        F.lit(False).alias("is_new"))
    new = u.join(base.select("name"), "name", "left_anti").select(
        "name", F.col("u_loc").alias("location"), F.col("u_hist").alias("medical_history"))
    if last_id is None:
        last_id = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = dense_index(new, ["name"], "id", int(last_id)).select(
        "id", "name", "location", "medical_history", F.lit(True).alias("is_new"))
    return matched.unionByName(new)


def enrich_reports(cases: DataFrame) -> DataFrame:
    """Report rows for scored cases: inferred disease, JSON details and
    an ISO timestamp taken from the case (not the wall clock)."""
    spec = C.choose_specialty(F.col("symptoms"))
    score = C.risk_score(F.col("symptoms"), F.col("age"))
    details = F.to_json(F.struct(F.lit("batch").alias("source"), F.col("case_id").alias("case_id")))
    return cases.select(
        "case_id", "patient_id", "hospital", "symptoms", spec.alias("specialty"),
        C.infer_disease(F.col("symptoms"), spec).alias("disease"), score.alias("risk_score"),
        C.risk_priority(score).alias("priority"), C.risk_recommendation(score).alias("recommendation"),
        details.alias("details"),
        F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
    )
