"""Dashboard questions over the adapter views."""

from __future__ import annotations

from wardlake.operators import dashboard as D
from wardlake.plans.registry import register
from wardlake.sources import fixtures as V


def _top_sql(view: str, keys: list[str], count_name: str, n: int | None, keep_null: bool) -> str:
    k = ", ".join(keys)
    where = "" if keep_null else f" WHERE {keys[0]} IS NOT NULL"
    order = f" ORDER BY {count_name} DESC, " + ", ".join(f"{x} ASC NULLS FIRST" for x in keys) if n else ""
    limit = f" LIMIT {n}" if n else ""
    return f"SELECT {k}, count(*) AS {count_name} FROM {view}{where} GROUP BY {k}{order}{limit}"


@register("common_diseases", _top_sql("reports_v", ["disease"], "count", 10, False))
def common_diseases(spark, sf):
    return D.common_diseases(V.reports_v(spark, sf), 10, keep_null=False)


@register("common_diseases_with_null", _top_sql("reports_v", ["disease"], "count", 10, True))
def common_diseases_with_null(spark, sf):
    return D.common_diseases(V.reports_v(spark, sf), 10, keep_null=True)


@register("common_symptoms", _top_sql("cases_v", ["symptoms"], "count", 10, True))
def common_symptoms(spark, sf):
    return D.common_symptoms(V.cases_v(spark, sf), 10)


@register("busy_doctors", _top_sql("appointments_v", ["doctor_name", "specialty"], "appointments", 10, False))
def busy_doctors(spark, sf):
    return D.busy_doctors(V.appointments_v(spark, sf), 10, keep_null=False)


@register("busy_doctors_with_null", _top_sql("appointments_v", ["doctor_name", "specialty"], "count", 10, True))
def busy_doctors_with_null(spark, sf):
    return D.busy_doctors(V.appointments_v(spark, sf), 10, keep_null=True)


@register("busy_doctors_single_key", _top_sql("appointments_v", ["doctor_name"], "count", 10, True))
def busy_doctors_single_key(spark, sf):
    return D.busy_doctors(V.appointments_v(spark, sf), 10, keep_null=True, keys=("doctor_name",))


@register("hospital_load", _top_sql("appointments_v", ["hospital"], "appointments", None, False))
def hospital_load(spark, sf):
    return D.hospital_load(V.appointments_v(spark, sf), keep_null=False)


@register("hospital_load_with_null", _top_sql("appointments_v", ["hospital"], "count", None, True))
def hospital_load_with_null(spark, sf):
    return D.hospital_load(V.appointments_v(spark, sf), keep_null=True)


@register("emergency_trends", """
SELECT coalesce(nullif(substr(generated_at, 1, 10), ''), 'unknown') AS date, priority, count(*) AS count
FROM reports_v WHERE priority IN ('Emergency', 'High') GROUP BY 1, 2""")
def emergency_trends(spark, sf):
    return D.emergency_trends(V.reports_v(spark, sf), blank_day="unknown")


@register("emergency_trends_lake", """
SELECT substr(generated_at, 1, 10) AS date, priority, count(*) AS count
FROM reports_v WHERE priority IN ('Emergency', 'High') GROUP BY 1, 2""")
def emergency_trends_lake(spark, sf):
    return D.emergency_trends(V.reports_v(spark, sf), blank_day=None)


@register("emergency_count", """
SELECT priority, count(*) AS count FROM reports_v WHERE priority = 'Emergency' GROUP BY priority""")
def emergency_count(spark, sf):
    return D.emergency_count(V.reports_v(spark, sf))


@register("totals", """
SELECT (SELECT count(*) FROM patients_v) AS patients, (SELECT count(*) FROM doctors_v) AS doctors,
       (SELECT count(*) FROM appointments_v) AS appointments, (SELECT count(*) FROM reports_v) AS reports,
       (SELECT count(*) FROM reports_v WHERE priority = 'Emergency') AS emergency_reports""")
def totals(spark, sf):
    return D.totals(V.patients_v(spark, sf), V.doctors_v(spark, sf), V.appointments_v(spark, sf),
                    V.reports_v(spark, sf))
