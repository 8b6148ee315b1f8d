"""Lake write-path queries: report enrichment, upserts, schema reconcile,
export round trip, saved reports and chats, merges (A3, A8-A11, A13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.plans.registry import register
from wardlake.session import scratch_dir
from wardlake.sources import fixtures as V
from wardlake.sources import lake as L
from wardlake.sources import store as ST
from wardlake.sources.tables import table


@register("reports_enrich", lambda: f"""SELECT case_id, patient_id, hospital, symptoms, specialty,
    {C.sql_infer_disease('symptoms', 'specialty')} AS disease, risk_score,
    {C.sql_risk_priority('risk_score')} AS priority, {C.sql_risk_recommendation('risk_score')} AS recommendation,
    to_json({{'source': 'batch', 'case_id': case_id}})::VARCHAR AS details,
    strftime(reported_at, '%Y-%m-%dT%H:%M:%S') AS generated_at
    FROM (SELECT *, {C.sql_choose_specialty('symptoms')} AS specialty, {C.sql_risk_score('symptoms', 'age')} AS risk_score
          FROM cases_v) c""")
def reports_enrich(spark, sf):
    return L.enrich_reports(V.cases_v(spark, sf))


@register("patients_upsert", ("""SELECT p.id, p.name, coalesce(nullif(u.u_loc, ''), p.location) AS location,
           coalesce(nullif(u.u_hist, ''), p.medical_history) AS medical_history, false AS is_new
    FROM patients_v p LEFT JOIN upd u USING (name)
    UNION ALL
    SELECT (SELECT max(id) FROM patients_v) + row_number() OVER (ORDER BY u.name) AS id, u.name, u.u_loc, u.u_hist, true
    FROM upd u WHERE NOT EXISTS (SELECT 1 FROM patients_v p WHERE p.name = u.name)""", {
    "upd": "SELECT name, max(location) AS u_loc, max(medical_history) AS u_hist FROM patient_updates_v GROUP BY name"}))
def patients_upsert(spark, sf):
    return L.upsert_patients(V.patients_v(spark, sf), V.patient_updates_v(spark, sf))


def _doctor_updates(spark, sf):
    """Refresh batch: every supplier re-sent under id 2*suppkey (even ids up
    to the current maximum replace rows, larger ones are new), with one more
    year of experience and availability reset."""
    d = V.doctors_v(spark, sf)
    return d.select((F.col("id") * 2).alias("id"), "name", "hospital", "specialty",
                    (F.col("experience") + 1).alias("experience"), F.lit(True).alias("available"))


@register("doctors_upsert", """SELECT * FROM doctors_v WHERE id NOT IN (SELECT id * 2 FROM doctors_v)
    UNION ALL SELECT id * 2 AS id, name, hospital, specialty, experience + 1 AS experience, true AS available FROM doctors_v""")
def doctors_upsert(spark, sf):
    return L.upsert_by_key(V.doctors_v(spark, sf), _doctor_updates(spark, sf), "id")


@register("schema_reconcile", """SELECT id, name, 'Texas Health Frisco' AS hospital, specialty, 5 AS experience,
    CAST(NULL AS VARCHAR) AS available_time, true AS available FROM doctors_v""")
def schema_reconcile(spark, sf):
    """An older doctors table (id, name, specialty) brought to the current schema."""
    old = V.doctors_v(spark, sf).select("id", "name", "specialty")
    return L.reconcile(old, L.DOCTORS_SCHEMA, L.DOCTOR_DEFAULTS)


@register("lake_roundtrip", """SELECT 'reports' AS "table", count(*) AS "rows" FROM reports_v
    UNION ALL SELECT 'appointments', count(*) FROM appointments_v
    UNION ALL SELECT 'doctors', count(*) FROM doctors_v""")
def lake_roundtrip(spark, sf):
    """Export reports, appointments and doctors as Parquet under the shared
    checkpoint folder, read them back, and count the rows of each."""
    base = scratch_dir(spark, f"export-{uuid.uuid4().hex}")
    tables = {"reports": V.reports_v(spark, sf), "appointments": V.appointments_v(spark, sf),
              "doctors": V.doctors_v(spark, sf)}
    L.export_tables(tables, base)
    parts = [spark.read.parquet(f"{base}/{n}").agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(n).alias("table"), "rows") for n in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _store(spark, name: str) -> str:
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


@register("report_saves", lambda: (f"""SELECT save_id, coalesce(p.id, n.id) AS patient_id, patient_name, hospital, symptoms,
    {C.sql_infer_disease('symptoms', 'specialty')} AS disease, specialty, risk_score,
    {C.sql_risk_priority('risk_score')} AS priority, {C.sql_risk_recommendation('risk_score')} AS recommendation,
    details, generated_at, batch
    FROM saves LEFT JOIN patients_v p ON p.name = patient_name LEFT JOIN created n ON n.name = patient_name""", {
    "saves": f"""SELECT c.case_id AS save_id, c.hospital, c.symptoms, {C.sql_choose_specialty('c.symptoms')} AS specialty,
        {C.sql_risk_score('c.symptoms', 'c.age')} AS risk_score,
        CASE WHEN c.case_id % 31 = 0 THEN '{K.DEFAULT_PATIENT}' WHEN c.case_id % 7 = 0 THEN concat('Visitor#', c.patient_id)
             ELSE coalesce(p.name, '{K.DEFAULT_PATIENT}') END AS patient_name,
        CASE WHEN c.case_id % 5 = 0 THEN '{{}}' ELSE to_json({{'source': 'desk', 'bp': c.bp,
             'note': CASE WHEN c.case_id % 3 = 0 THEN 'follow-up' END}})::VARCHAR END AS details,
        strftime(c.reported_at, '%Y-%m-%dT%H:%M:%S') AS generated_at, concat('day', c.case_id % 2) AS batch
        FROM cases_v c LEFT JOIN patients_v p ON p.id = c.patient_id""",
    "created": """SELECT name, (SELECT max(id) FROM patients_v) + row_number() OVER (ORDER BY b, name) AS id FROM (
        SELECT patient_name AS name, min(batch) AS b FROM saves
        WHERE patient_name NOT IN (SELECT name FROM patients_v) GROUP BY patient_name)"""}))
def report_saves(spark, sf):
    """The reports of all cases saved in two batches, the first of them twice: patients
    looked up by name, unknown ones created, the caller's details kept."""
    cases = V.cases_v(spark, sf)
    known = V.patients_v(spark, sf).select(F.col("id").alias("patient_id"), "name")
    spec, score = C.choose_specialty(F.col("symptoms")), C.risk_score(F.col("symptoms"), F.col("age"))
    saves = cases.join(known, "patient_id", "left").select(
        F.col("case_id").alias("save_id"), "hospital", "symptoms", spec.alias("specialty"), score.alias("risk_score"),
        C.risk_priority(score).alias("priority"), C.risk_recommendation(score).alias("recommendation"),
        F.when(F.col("case_id") % 31 == 0, F.lit(None).cast("string"))
         .when(F.col("case_id") % 7 == 0, F.concat(F.lit("Visitor#"), F.col("patient_id")))
         .otherwise(F.col("name")).alias("patient_name"),
        F.when(F.col("case_id") % 5 != 0, F.struct(
            F.lit("desk").alias("source"), F.col("bp").alias("bp"),
            F.when(F.col("case_id") % 3 == 0, "follow-up").alias("note"))).alias("details"),
        F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"))
    store = _store(spark, "report-store")
    L.write_table(V.patients_v(spark, sf), f"{store}/patients")
    for batch in (0, 1, 0):
        ST.save_reports(saves.filter(F.col("save_id") % 2 == batch), store, f"day{batch}")
    return ST.stored(spark, f"{store}/reports", ST.REPORTS)


@register("chat_history", f"""SELECT (SELECT max(id) + 1 FROM patients_v) AS patient_id, u.conv_id::VARCHAR AS session_id, u.turn,
    u.text AS message, coalesce(nullif(a.text, ''), to_json({{'reply': a.text, 'agent': 'Healthcare Agent',
      'risk_score': u.turn * 10}})::VARCHAR) AS reply, concat('turn-', u.turn) AS timestamp, 'day0' AS batch
    FROM conversations u LEFT JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user' AND u.conv_id IS NOT NULL""")
def chat_history(spark, sf):
    """Every user turn saved with its response (the next assistant turn's text beside the
    bulky fields, which the stored JSON leaves out), twice under one batch."""
    c = table(spark, sf, "conversations")
    answers = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    response = F.struct(
        F.col("answer").alias("reply"), F.lit("Healthcare Agent").alias("agent"), (F.col("turn") * 10).alias("risk_score"),
        *[F.col("text").alias(f) for f in K.CHAT_DROPPED_FIELDS])
    turns = c.filter(F.col("role") == "user").join(answers, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("message"), response.alias("response"),
        F.concat(F.lit("turn-"), F.col("turn")).alias("timestamp"))
    store = _store(spark, "chat-store")
    L.write_table(V.patients_v(spark, sf), f"{store}/patients")
    for _ in range(2):
        ST.save_chats(turns, store, "day0")
    return ST.stored(spark, f"{store}/chat_history", ST.CHATS)


@register("doctors_merge", """SELECT * FROM doctors_v WHERE id NOT IN (SELECT id * 2 FROM doctors_v)
    UNION ALL SELECT id * 2 AS id, name, hospital, specialty, experience + 1 AS experience, true AS available FROM doctors_v""")
def doctors_merge(spark, sf):
    """``doctors_upsert`` in place: a table keyed by id, two batches of updates merged."""
    doctors, updates = V.doctors_v(spark, sf), _doctor_updates(spark, sf)
    t = ST.KeyedTable(spark, _store(spark, "doctors-keyed"), "id", doctors.schema)
    t.write(doctors)
    for half in (0, 1):
        t.merge(updates.filter(F.col("id") % 4 == 2 * half))
    return t.read()


@register("patients_merge", ("""SELECT p.id, p.name, coalesce(nullif(u.u_loc, ''), p.location) AS location,
           coalesce(nullif(u.u_hist, ''), p.medical_history) AS medical_history
    FROM patients_v p LEFT JOIN upd u USING (name)
    UNION ALL
    SELECT (SELECT max(id) FROM patients_v) + row_number() OVER (ORDER BY u.name) AS id, u.name, u.u_loc, u.u_hist
    FROM upd u WHERE NOT EXISTS (SELECT 1 FROM patients_v p WHERE p.name = u.name)""", {
    "upd": "SELECT name, max(location) AS u_loc, max(medical_history) AS u_hist FROM patient_updates_v GROUP BY name"}))
def patients_merge(spark, sf):
    """``patients_upsert`` in place, the batch merged twice: the second changes nothing."""
    patients, updates = V.patients_v(spark, sf), V.patient_updates_v(spark, sf)
    t = ST.KeyedTable(spark, _store(spark, "patients-keyed"), "name", patients.schema)
    t.write(patients)
    for _ in range(2):
        ST.merge_patients(t, updates)
    return t.read()
