"""L2: emergency trend over report files appended to a folder.

``readStream`` over the report folder, counts per (day, priority) in update or
complete mode.  The state has one row per day and priority, so there is no
watermark: late reports count, and undated ones count under 'unknown', as in the
batch ``emergency_trends``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.functions.clinical import nonblank
from wardlake.operators.dashboard import EMERGENCY_LEVELS

REPORT_STREAM_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType()), T.StructField("priority", T.StringType()),
    T.StructField("generated_at", T.StringType()),
])


def report_stream(spark: SparkSession, folder: str, schema: T.StructType = REPORT_STREAM_SCHEMA,
                  max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def emergency_trend_stream(reports: DataFrame) -> DataFrame:
    day = F.coalesce(nonblank(F.substring("generated_at", 1, 10)), F.lit("unknown"))
    return (reports.filter(F.col("priority").isin(*EMERGENCY_LEVELS))
            .groupBy(day.alias("date"), "priority").count())
