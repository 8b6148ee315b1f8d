"""Hospital dashboard questions.

Each function takes the relevant table(s) as DataFrames and returns a
DataFrame; the caller decides when to collect.  The two historical flavours
are kept: the SQL flavour (null keys excluded, count column named
``appointments`` for doctor/hospital questions, blank day -> 'unknown') and
the lake flavour (null keys kept as a group, count named ``count``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.functions.clinical import nonblank
from wardlake.operators.topk import count_top

EMERGENCY_LEVELS = ("Emergency", "High")


def common_diseases(reports: DataFrame, n: int = 10, keep_null: bool = False) -> DataFrame:
    return count_top(reports, ["disease"], n, keep_null, "count")


def common_symptoms(appointments: DataFrame, n: int = 10) -> DataFrame:
    return count_top(appointments, ["symptoms"], n, True, "count")


def busy_doctors(appointments: DataFrame, n: int = 10, keep_null: bool = False,
                 keys: tuple[str, ...] = ("doctor_name", "specialty")) -> DataFrame:
    missing = [k for k in keys if k not in appointments.columns]
    if missing:  # column-existence guard: empty answer with the expected schema
        spark = appointments.sparkSession
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", appointments bigint")
    return count_top(appointments, list(keys), n, keep_null, "count" if keep_null else "appointments")


def hospital_load(appointments: DataFrame, keep_null: bool = False) -> DataFrame:
    return count_top(appointments, ["hospital"], None, keep_null, "count" if keep_null else "appointments")


def emergency_trends(reports: DataFrame, blank_day: str | None = "unknown") -> DataFrame:
    """Counts of Emergency/High reports per (day, priority), in that order.

    blank_day='unknown' (SQL flavour): a null or blank timestamp becomes
    'unknown'.  blank_day=None (lake flavour): the first 10 characters as is.
    """
    day = F.substring(F.col("generated_at"), 1, 10)
    if blank_day is not None:
        day = F.coalesce(nonblank(day), F.lit(blank_day))
    return (reports.filter(F.col("priority").isin(*EMERGENCY_LEVELS))
            .groupBy(day.alias("date"), F.col("priority"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("date", "priority"))


def emergency_count(df: DataFrame, column: str = "priority") -> DataFrame:
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"{column} string, count bigint")
    return df.filter(F.col(column) == "Emergency").groupBy(column).agg(F.count(F.lit(1)).alias("count"))


TOTAL_METRICS = ("patients", "doctors", "appointments", "reports", "emergency_reports")


def totals(patients: DataFrame, doctors: DataFrame, appointments: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of table counts.  Each table is scanned once and reduced to one row of
    counts (partial counts per partition); a last aggregate lays the rows side by side."""
    every = F.count(F.lit(1))

    def counts(df: DataFrame, **values) -> DataFrame:
        return df.agg(*[values.get(m, F.lit(0).cast("long")).alias(m) for m in TOTAL_METRICS])

    rows = (counts(patients, patients=every).unionByName(counts(doctors, doctors=every))
            .unionByName(counts(appointments, appointments=every))
            .unionByName(counts(reports, reports=every, emergency_reports=F.count_if(F.col("priority") == "Emergency"))))
    return rows.agg(*[F.sum(m).alias(m) for m in TOTAL_METRICS])


def dashboard_bundle(reports: DataFrame, appointments: DataFrame, patients: DataFrame,
                     doctors: DataFrame) -> dict[str, DataFrame]:
    """K7: the dashboard's four questions and totals, one lazy DataFrame each
    (SQL flavour).  The caller runs them; nothing is collected here."""
    return {
        "most_common_disease": common_diseases(reports, 10, keep_null=False),
        "most_busy_doctor": busy_doctors(appointments, 10, keep_null=False),
        "hospital_load": hospital_load(appointments, keep_null=False),
        "emergency_trends": emergency_trends(reports, blank_day="unknown"),
        "totals": totals(patients, doctors, appointments, reports),
    }
