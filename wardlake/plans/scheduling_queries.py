"""Doctor, slot, hospital-recommendation and booking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.functions import timefn as T
from wardlake.functions.rules import q
from wardlake.operators import scheduling as S
from wardlake.plans.registry import register
from wardlake.sources import fixtures as V

_OPEN = """SELECT s.id AS slot_id, d.name AS doctor_name, d.hospital, d.specialty, s.date, s.time, d.id AS doctor_id
    FROM slots_v s JOIN doctors_v d ON s.doctor_id = d.id WHERE s.available = 1"""

_FIRSTS = """SELECT h, s, slot_id, doctor_name, specialty, date, time FROM (
    SELECT lower(hospital) AS h, lower(specialty) AS s, *, row_number() OVER (
      PARTITION BY lower(hospital), lower(specialty) ORDER BY slot_id) AS rn FROM open_s) x WHERE rn = 1"""


@register("available_slots", ("SELECT slot_id, doctor_name, hospital, specialty, date, time FROM open_s",
                              {"open_s": _OPEN}))
def available_slots(spark, sf):
    return S.open_slots(V.slots_v(spark, sf), V.doctors_v(spark, sf))


@register("hospitals_with_specialty", ("SELECT DISTINCT specialty, hospital FROM open_s", {"open_s": _OPEN}))
def hospitals_with_specialty(spark, sf):
    return S.hospitals_with_specialty(V.slots_v(spark, sf), V.doctors_v(spark, sf))


@register("top3_slots", ("""SELECT slot_id, doctor_name, hospital, specialty, date, time, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY specialty ORDER BY slot_id) AS INTEGER) AS rank FROM open_s) x
    WHERE rank <= 3""", {"open_s": _OPEN}))
def top3_slots(spark, sf):
    return S.top_slots(V.slots_v(spark, sf), V.doctors_v(spark, sf), 3)


@register("find_doctors", "SELECT id, name, hospital, specialty, experience FROM doctors_v WHERE available")
def find_doctors(spark, sf):
    return S.available_doctors(V.doctors_v(spark, sf))


_TIMES = ("09:30 AM", "10:00 AM", "11:30 AM", "02:00 PM")


@register("find_specialists", f"""SELECT id, name, hospital, specialty, experience, available_time FROM (
    SELECT *, [{', '.join(q(t) for t in _TIMES)}][id % {len(_TIMES)} + 1] AS available_time FROM doctors_v) d
    WHERE available AND specialty = 'Cardiology'""")
def find_specialists(spark, sf):
    """Doctors of exactly one specialty, with the time they are available."""
    time = F.element_at(F.array(*[F.lit(t) for t in _TIMES]), (F.col("id") % len(_TIMES) + 1).cast("int"))
    return S.available_doctors(V.doctors_v(spark, sf).withColumn("available_time", time), "Cardiology")


@register("search_slots", ("""SELECT slot_id, doctor_name, hospital, specialty, date, time FROM open_s
    WHERE hospital ILIKE '%PLANO%' AND specialty ILIKE 'c_rdio%'""", {"open_s": _OPEN}))
def search_slots(spark, sf):
    """Open slots by hospital and specialty patterns, whatever the case."""
    return S.open_slots(V.slots_v(spark, sf), V.doctors_v(spark, sf), "%PLANO%", "c_rdio%")


@register("slot_text_parts", f"""SELECT id, CAST(date AS VARCHAR) AS date,
    CASE WHEN available = 1 THEN time ELSE '{K.DEFAULT_SLOT_TIME}' END AS time FROM slots_v""")
def slot_text_parts(spark, sf):
    """Date and time from one text; a closed slot's text has no time here."""
    s = V.slots_v(spark, sf)
    text = F.when(F.col("available") == 1, F.concat_ws(" ", "date", "time")).otherwise(F.col("date"))
    date, time = T.split_date_time(text)
    return s.select("id", date.alias("date"), time.alias("time"))


@register("best_doctor", """SELECT specialty, doctor_id, doctor_name, experience FROM (
    SELECT specialty, id AS doctor_id, name AS doctor_name, experience,
           row_number() OVER (PARTITION BY specialty ORDER BY experience DESC, id ASC) AS rn
    FROM doctors_v WHERE available) x WHERE rn = 1""")
def best_doctor(spark, sf):
    return S.best_doctor(V.doctors_v(spark, sf))


def _rule_specialty_sql() -> tuple[str, dict]:
    from wardlake.plans.matching_queries import _rule_ctes
    return _rule_ctes()


@register("first_doctor", lambda: ("""SELECT c.case_id, c.recommended_specialty AS specialty, f.doctor_id, f.doctor_name,
    f.experience, f.doctor_id IS NOT NULL AS doctor_found,
    CASE WHEN f.doctor_id IS NULL THEN 'No available ' || c.recommended_specialty || ' found. Recommending General Physician.' END
      AS message
    FROM rule_case c LEFT JOIN (
      SELECT specialty, id AS doctor_id, name AS doctor_name, experience FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty ORDER BY id) AS rn FROM doctors_v WHERE available) x
      WHERE rn = 1) f ON f.specialty = c.recommended_specialty""", _rule_specialty_sql()))
def first_doctor(spark, sf):
    from wardlake.plans.matching_queries import scored_cases
    c = scored_cases(spark, sf).select("case_id", F.col("recommended_specialty").alias("specialty"))
    return S.first_doctor(c, V.doctors_v(spark, sf)).select(
        "case_id", "specialty", "doctor_id", "doctor_name", "experience", "doctor_found", "message")


def _case_keys(spark, sf):
    c = V.cases_v(spark, sf)
    return c.select("case_id", "hospital", C.choose_specialty(F.col("symptoms")).alias("specialty"),
                    C.location_from_message(F.col("hospital")).alias("location"))


def _sql_case_keys() -> str:
    return (f"SELECT case_id, hospital, {C.sql_choose_specialty('symptoms')} AS specialty, "
            f"{C.sql_location_from_message('hospital')} AS location FROM cases_v")


def _sql_recommend(exclude: bool) -> tuple[str, dict]:
    keys = ["specialty", "location"] + (["chosen_hospital"] if exclude else [])
    kc = ", ".join(keys)
    known = ", ".join(f"({q(h)}, {i})" for i, h in enumerate(K.HOSPITALS))
    pref_whens = " ".join(f"WHEN lower(c.location) = {q(loc)} AND c.cand = {q(h)} THEN {i}"
                          for loc, hs in K.LOCATION_HOSPITALS.items() for i, h in enumerate(hs))
    locs = ", ".join(q(x) for x in K.LOCATION_HOSPITALS)
    n = len(K.HOSPITALS)
    pk = ", ".join(f"c.{k}" for k in keys)
    ctes = {
        "open_s": _OPEN,
        "avail": "SELECT DISTINCT specialty, hospital FROM open_s",
        "ckeys": f"SELECT DISTINCT {kc} FROM (SELECT *, hospital AS chosen_hospital FROM ({_sql_case_keys()}) y) x",
        "known_h": f"SELECT * FROM (VALUES {known}) v(cand, hord)",
        "cand": f"""SELECT {kc}, cand, min(hord) AS hord FROM (
            SELECT k.*, h.cand, h.hord FROM ckeys k CROSS JOIN known_h h
            UNION ALL SELECT k.*, a.hospital AS cand, {n} AS hord FROM ckeys k JOIN avail a USING (specialty)) x
            GROUP BY {kc}, cand""",
        "cand2": f"""SELECT c.*, a.specialty IS NOT NULL AS av FROM cand c
            LEFT JOIN avail a ON a.specialty = c.specialty AND a.hospital = c.cand""",
        "cand3": f"""SELECT c.*, av OR NOT bool_or(av) OVER (PARTITION BY {pk}) AS is_av,
            CASE WHEN lower(coalesce(c.location, '')) IN ({locs}) THEN (CASE {pref_whens} END)
                 WHEN c.hord < {n} THEN c.hord END AS pref FROM cand2 c""",
        "ranked": f"""SELECT {kc}, cand, CAST(row_number() OVER (PARTITION BY {kc}
            ORDER BY CASE WHEN pref IS NOT NULL AND is_av THEN 1 WHEN is_av THEN 2 ELSE 3 END,
                     CASE WHEN pref IS NOT NULL AND is_av THEN pref ELSE hord END, cand) AS INTEGER) AS rank FROM cand3""",
    }
    if not exclude:
        return f"SELECT specialty, location, rank, cand AS hospital FROM ranked WHERE rank <= 3", ctes
    return (f"""SELECT specialty, location, chosen_hospital, CAST(row_number() OVER (PARTITION BY {kc} ORDER BY rank)
        AS INTEGER) AS rank, cand AS hospital FROM ranked
        WHERE rank <= 3 AND lower(cand) <> lower(coalesce(chosen_hospital, ''))""", ctes)


@register("recommend_hospitals", lambda: _sql_recommend(False))
def recommend_hospitals(spark, sf):
    keys = _case_keys(spark, sf)
    return S.recommend_hospitals(keys, V.slots_v(spark, sf), V.doctors_v(spark, sf), 3)


@register("alternative_hospitals", lambda: _sql_recommend(True))
def alternative_hospitals(spark, sf):
    keys = _case_keys(spark, sf).withColumnRenamed("hospital", "chosen_hospital")
    return S.recommend_hospitals(keys, V.slots_v(spark, sf), V.doctors_v(spark, sf), 3,
                                 exclude_col="chosen_hospital")


@register("pick_slot_fallback", lambda: ("""SELECT c.case_id, coalesce(m.slot_id, f.slot_id) AS slot_id,
    m.slot_id IS NULL AND f.slot_id IS NOT NULL AS is_fallback,
    CASE WHEN m.slot_id IS NOT NULL THEN m.doctor_name || ' (' || m.specialty || ') at ' || m.time || ' (' || m.date || ')'
         WHEN f.slot_id IS NOT NULL THEN f.doctor_name || ' (General Physician - Fallback) at ' || f.time || ' (' || f.date || ')'
         ELSE 'No doctors available at this time.' END AS doctor
    FROM ckeys c
    LEFT JOIN firsts m ON m.h = lower(c.hospital) AND m.s = lower(c.specialty)
    LEFT JOIN firsts f ON f.h = lower(c.hospital) AND f.s = 'general physician'""", {
    "open_s": _OPEN,
    "ckeys": _sql_case_keys(),
    "firsts": _FIRSTS}))
def pick_slot_fallback(spark, sf):
    keys = _case_keys(spark, sf).select("case_id", "hospital", "specialty")
    r = S.first_slot_with_fallback(keys, V.slots_v(spark, sf), V.doctors_v(spark, sf))
    return r.select("case_id", "slot_id", "is_fallback", "doctor")


_BOOK_CTES = {
    "open_s": _OPEN,
    "winners": """SELECT slot_id, request_id, patient_id, requested_at FROM (
        SELECT r.*, row_number() OVER (PARTITION BY r.slot_id ORDER BY r.requested_at, r.request_id) AS rn
        FROM requests_v r JOIN open_s o ON r.slot_id = o.slot_id) x WHERE rn = 1""",
}


@register("book_slots", ("""SELECT w.request_id, w.slot_id, w.patient_id, o.doctor_id, o.doctor_name, o.hospital,
    o.specialty, o.date AS appointment_date, o.time AS appointment_time, 'Scheduled' AS urgency, 'Confirmed' AS status,
    w.requested_at AS created_at
    FROM winners w JOIN open_s o ON w.slot_id = o.slot_id""", _BOOK_CTES))
def book_slots(spark, sf):
    return S.book(V.requests_v(spark, sf), V.slots_v(spark, sf), V.doctors_v(spark, sf))["accepted"]


@register("book_rejects", ("""SELECT r.request_id, r.slot_id, 'failed' AS status,
    'Slot not available or does not exist' AS message FROM requests_v r
    WHERE NOT EXISTS (SELECT 1 FROM winners w WHERE w.slot_id = r.slot_id AND w.request_id = r.request_id)""", _BOOK_CTES))
def book_rejects(spark, sf):
    return S.book(V.requests_v(spark, sf), V.slots_v(spark, sf), V.doctors_v(spark, sf))["rejected"]


@register("slots_after", ("""SELECT s.id, s.doctor_id, s.date, s.time,
    CAST(CASE WHEN w.slot_id IS NOT NULL THEN 0 ELSE s.available END AS INTEGER) AS available
    FROM slots_v s LEFT JOIN winners w ON w.slot_id = s.id""", _BOOK_CTES))
def slots_after(spark, sf):
    return S.book(V.requests_v(spark, sf), V.slots_v(spark, sf), V.doctors_v(spark, sf))["slots_after"]


@register("triage_with_doctor", lambda: ("""SELECT t.case_id, t.specialty, t.priority, t.reason, b.doctor_id, b.doctor_name,
    b.experience, CASE WHEN b.doctor_id IS NULL THEN 'No doctor available' ELSE 'Booked' END AS booking_status
    FROM (SELECT case_id, {0} AS specialty, {1} AS priority, {2} AS reason FROM cases_v) t
    LEFT JOIN best b ON b.specialty = t.specialty""".format(*C.sql_patient_triage("symptoms", "history")), {
    "best": """SELECT specialty, doctor_id, doctor_name, experience FROM (
        SELECT specialty, id AS doctor_id, name AS doctor_name, experience,
               row_number() OVER (PARTITION BY specialty ORDER BY experience DESC, id ASC) AS rn
        FROM doctors_v WHERE available) x WHERE rn = 1"""}))
def triage_with_doctor(spark, sf):
    sp, pr, rs = C.patient_triage(F.col("symptoms"), F.col("history"))
    t = V.cases_v(spark, sf).select("case_id", sp.alias("specialty"), pr.alias("priority"), rs.alias("reason"))
    return S.triage_with_doctor(t, V.doctors_v(spark, sf)).select(
        "case_id", "specialty", "priority", "reason", "doctor_id", "doctor_name", "experience", "booking_status")
