"""Hand-derived expected values on small invented tables and on the rules."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.functions import timefn as T
from wardlake.operators import consensus as CS
from wardlake.operators import dashboard as D
from wardlake.operators import matching as M
from wardlake.operators import retrieval as RT
from wardlake.operators import scheduling as S
from wardlake.sources import lake as L

# Invented rows: three clinics, five doctors.
APPOINTMENTS_CSV = """patient,symptoms,specialty,risk,hospital,doctor,priority
Pat A,cough,Pulmonology,55,North Clinic,Dr. Birch,High
Pat B,cough,Pulmonology,80,North Clinic,Dr. Birch,Emergency
Pat C,fever,General Physician,20,Harbor Clinic,Dr. Elm,Routine
Pat D,cough,Pulmonology,85,North Clinic,Dr. Ash,Emergency
Pat E,rash,Dermatology,30,Hill Clinic,Dr. Elm,Routine
"""

DOCTORS = [(1, "Dr. Ash", "North Clinic", "Pulmonology", 6, True), (2, "Dr. Birch", "North Clinic", "Pulmonology", 21, True),
           (3, "Dr. Cedar", "Hill Clinic", "Pulmonology", 9, True), (4, "Dr. Dogwood", "Hill Clinic", "Dermatology", 3, True),
           (5, "Dr. Elm", "Harbor Clinic", "General Physician", 30, True)]
SLOTS = [(1, 1, "2031-03-01", "09:00 AM", 1), (2, 2, "2031-03-01", "10:00 AM", 0), (3, 3, "2031-03-02", "09:00 AM", 1),
         (4, 4, "2031-03-02", "10:00 AM", 1), (5, 5, "2031-03-03", "09:00 AM", 1), (6, 2, "2031-03-04", "01:00 PM", 1)]


@pytest.fixture
def clinics(spark):
    d = spark.createDataFrame(DOCTORS, "id long, name string, hospital string, specialty string, experience int, available boolean")
    return d, spark.createDataFrame(SLOTS, "id long, doctor_id long, date string, time string, available int")


def test_csv_dashboard(spark, tmp_dir):
    path = os.path.join(tmp_dir, "visits.csv")
    with open(path, "w") as f:
        f.write(APPOINTMENTS_CSV)
    df = L.read_csv(spark, path, L.APPOINTMENTS_CSV_SCHEMA)
    assert dict(rows(D.common_symptoms(df, 10), "symptoms", "count")) == {"cough": 3, "fever": 1, "rash": 1}
    docs = rows(D.busy_doctors(df, 10, keep_null=True, keys=("doctor",)), "doctor", "count")
    assert docs == [("Dr. Birch", 2), ("Dr. Elm", 2), ("Dr. Ash", 1)]
    assert rows(D.hospital_load(df, keep_null=True), "hospital", "count") == [("North Clinic", 3), ("Harbor Clinic", 1), ("Hill Clinic", 1)]
    assert rows(D.emergency_count(df)) == [("Emergency", 2)]
    # column-existence guard
    assert D.busy_doctors(df.drop("doctor"), 10, True, keys=("doctor",)).count() == 0
    assert D.emergency_count(df.drop("priority")).count() == 0


def test_chat_rules(spark):
    df = spark.createDataFrame([("I have chest pain and diabetes", 55)], "s string, age int")
    score = C.risk_score(F.col("s"), F.col("age"))
    spec = C.choose_specialty(F.col("s"))
    r = df.select(score.alias("score"), spec.alias("spec"), C.risk_priority(score).alias("prio"),
                  C.infer_disease(F.col("s"), spec).alias("disease"),
                  RT.kb_overlap(F.col("s")).alias("kb")).first()
    assert (r.score, r.spec, r.prio, r.disease) == (65, "Cardiology", "High", "Cardiovascular Risk")
    assert r.kb == " | ".join([K.KB_SENTENCES[0], K.KB_SENTENCES[1], K.KB_SENTENCES[4]])


def test_slots_doctors_hospitals(spark, clinics):
    d, s = clinics
    assert rows(S.open_slots(s, d, "North Clinic", "Pulmonology").orderBy("slot_id"), "slot_id", "doctor_name") == [
        (1, "Dr. Ash"), (6, "Dr. Birch")]
    best = {r.specialty: (r.doctor_name, r.experience) for r in S.best_doctor(d).collect()}
    assert best == {"Pulmonology": ("Dr. Birch", 21), "Dermatology": ("Dr. Dogwood", 3), "General Physician": ("Dr. Elm", 30)}
    keys = spark.createDataFrame([("Pulmonology", "hill"), ("Pulmonology", None)], "specialty string, location string")
    rec = S.recommend_hospitals(keys, s, d, 3)
    assert [r.hospital for r in rec.filter("location = 'hill'").orderBy("rank").collect()][0] == "Hill Clinic"
    assert {"North Clinic", "Hill Clinic"} <= {r.hospital for r in rec.filter("location IS NULL").collect()}


def _rule_case(spark, symptoms, history):
    df = spark.createDataFrame([(1, symptoms, history)], "k int, symptoms string, history string")
    st, ht = M.case_texts(F.col("symptoms"), F.col("history"))
    ids = [r.rule_id for r in M.rule_match_rows(df, "k", st, ht).collect()]
    return ids, M.with_rule_scores(df, st, ht).first()


def test_rule_agent_and_bayes(spark):
    ids, r = _rule_case(spark, "chest pain", "diabetes")
    assert ids == [1, 4]
    assert (r.risk_score, r.recommended_specialty, r.priority) == (60, "Cardiology", "High")
    assert r.confidence == pytest.approx(0.60)
    assert (r.posterior_risk, r.risk_percentage) == (0.54, 54.0)
    ids, r = _rule_case(spark, "", "")
    assert ids == []
    assert (r.recommended_specialty, r.priority, r.risk_score, r.confidence) == ("General Physician", "Normal", 10, 0.10)
    assert r.posterior_risk == 0.10


def _kg(spark, symptoms, history=""):
    df = spark.createDataFrame([(1, symptoms, history)], "k int, s string, h string")
    text = M.kg_text(F.col("s"), F.col("h"))
    return M.kg_match_rows(df, "k", text).collect(), M.with_kg_scores(df, text).first()


def test_knowledge_graph(spark):
    edges, r = _kg(spark, "chest pain, diabetes")
    assert [(e.symptom, e.specialty, e.weight) for e in edges] == [("chest pain", "Cardiology", 40),
                                                                    ("diabetes", "Endocrinology", 20)]
    assert (r.kg_specialty, r.kg_risk_score) == ("Cardiology", 60)
    assert r.relationships.split(" | ")[0] == "Chest Pain → Cardiology (+40)"
    assert _kg(spark, "cough, headache")[1].kg_specialty == "Neurology"
    assert M.kg_nodes_frame(spark).count() == 28
    assert M.kg_edges_frame(spark).count() == 22


def test_risk_features_and_attribution(spark):
    df = spark.createDataFrame([("chest pain, shortness of breath", "diabetes, hypertension", 65, 150, 95, 240)],
                               "s string, h string, age int, bp int, hr int, chol int")
    text = C.list_text(F.concat_ws(", ", F.col("s"), F.col("h")))
    f = df.select(*C.risk_feature_columns(text, "age", "bp", "hr", "chol")).first()
    assert list(f) == pytest.approx([65, 150, 95, 240, 105, 1, 1, 1, 1, 2.5, 3.0, 2.0, 1.15])
    a = df.select(C.risk_attribution(text, F.col("age"), F.col("bp"), F.col("chol")).alias("a")).first().a
    assert [(x.name, x.points) for x in a] == [
        ("Chest Pain", 40), ("Shortness Of Breath", 30), ("Diabetes", 20), ("Hypertension", 15),
        ("Age (65)", 12), ("High BP (150)", 15), ("High Cholesterol (240)", 12)]
    labels = spark.createDataFrame([(x,) for x in (90, 85, 95, 70, 72, 65, 55, 50, 40, 35, 30, 20, 15, 10, 25)], "y int")
    got = [r[0] for r in labels.select(C.risk_label(F.col("y"))).collect()]
    assert got == [2, 2, 2, 2, 2, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_severity_urgency_uncertainty(spark):
    df = spark.createDataFrame([("severe chest pain", "")], "s string, h string")
    sev = C.severity_lists(F.col("s"), F.col("h"))
    r = df.select(sev["severity"].alias("sev"), sev["critical"].alias("crit")).first()
    assert (r.sev, r.crit) == ("Critical", ["chest pain"])
    one = spark.range(1)
    avg = (F.lit(54.0) + F.lit(90.0)) / 2
    r = one.select(C.appointment_urgency(avg).alias("u"), C.schedule_type(avg).alias("t")).first()
    assert (r.u, r.t) == ("Urgent", "today")
    conf = (F.lit(0.60) + (1 - F.lit(0.54)) + F.lit(0.9)) / 3
    r = one.select(conf.alias("c"), C.uncertainty_level(conf).alias("l")).first()
    assert r.c == pytest.approx(0.6533, abs=1e-4) and r.l == "Medium"


def test_votes(spark):
    v1 = spark.createDataFrame([(1, "phi", 1, "Urgent", "Neurology"), (1, "qwen", 2, "Emergency", "Cardiology"),
                                (1, "deepseek", 3, "Soon", "Neurology"),
                                (2, "phi", 1, "Urgent", "Neurology"), (2, "qwen", 2, "Urgent", "Cardiology"),
                                (2, "deepseek", 3, "Soon", "Pulmonology")],
                               "case_id long, model string, model_ord int, urgency string, specialty string")
    got = {r.case_id: r for r in CS.members(v1).collect()}
    assert (got[1].consensus_urgency, got[1].consensus_specialty, got[1].consensus_models) == (
        "Emergency", "Neurology", "QWEN")
    assert (got[2].consensus_urgency, got[2].consensus_specialty) == ("Urgent", "Neurology")


def test_baseline_and_reply_parsing(spark):
    df = spark.createDataFrame([("subpar sleep",)], "s string")
    u, s = C.clinical_baseline(F.col("s"))
    assert tuple(df.select(u, s).first()) == ("Urgent", "Cardiology")
    raw = "<think>x</think>\nUrgency: Soon!\nSpecialty: neurology\nExplanation:\nRest and hydrate well"
    r = spark.createDataFrame([(raw, "Routine", "General Physician")], "raw string, bu string, bs string")
    p = CS.parse_replies(r, "raw", "bu", "bs").first()
    assert (p.urgency, p.specialty, p.explanation) == ("Soon", "Neurology", "Rest and hydrate well")


def test_time_and_images(spark):
    df = spark.createDataFrame([("2026-06-20", "2:00 PM"), ("2026-06-20", "02:00 PM")], "d string, t string")
    got = rows(df.select(T.slot_start_text(F.col("d"), F.col("t")), T.slot_end_text(F.col("d"), F.col("t"))))
    assert got == [("2026-06-20 14:00:00", "2026-06-20 14:30:00")] * 2
    m = spark.createDataFrame([(200, 50), (201, 50)], "b int, c int")
    got = rows(m.select(F.when(C.image_abnormal(F.col("b"), F.col("c")), "abnormal").otherwise("normal"),
                        C.image_confidence(F.col("b"))))
    assert got[0][0] == "normal" and got[0][1] == pytest.approx(0.80)
    assert got[1][0] == "abnormal" and got[1][1] == pytest.approx(0.8025)
    sc = spark.createDataFrame([(0.55, 0.30, 0.15)], "n double, a double, i double")
    mx, dec = C.class_decision(F.col("n"), F.col("a"), F.col("i"))
    assert sc.select(dec).first()[0] == "inconclusive"


def test_reply_titles_blanks_and_thoughts(spark):
    r = spark.createDataFrame([("<think> two signs\n</think>\u00a0urgency: sOON!\n\u2003Specialty: 3d imaging\nCome in this week, please.", "Urgent", "Neurology"),
                               ("<think></think>Specialty: o'neil x-ray", "Urgent", "Neurology")], "raw string, bu string, bs string")
    p = CS.parse_replies(r, "raw", "bu", "bs").collect()
    assert [(x.urgency, x.specialty, x.explanation, x.think) for x in p] == [
        ("Soon", "3D Imaging", "Come in this week, please.", "<think>\ntwo signs\n</think>"),
        ("Urgent", "Oneil Xray", "Specialty: o'neil x-ray", None)]
