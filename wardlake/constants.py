"""Fixed values the results depend on.

FIXED VALUES: every list and table below must equal the clinical rules that
the triage service applies, in the order it applies them (order decides
first-match and tie-break results).  They are data, not logic: the operators
in ``wardlake.functions`` and ``wardlake.operators`` turn them into Spark
Column expressions or small dimension DataFrames.
"""

from __future__ import annotations

# --- FIXED VALUES -----------------------------------------------------------

# Disease inference: ordered (phrases, disease); else specialty, else default.
DISEASE_RULES = [
    (("chest pain", "shortness of breath", "high blood pressure", "hypertension"), "Cardiovascular Risk"),
    (("diabetes", "blood sugar"), "Diabetes"),
    (("fever", "cough"), "Respiratory Infection"),
    (("headache", "dizziness"), "Neurological Symptoms"),
    (("stomach", "nausea", "vomiting"), "Gastrointestinal Symptoms"),
]
DISEASE_DEFAULT = "General Symptoms"

# Rule risk score: (phrases, points); any phrase present adds the points once.
RISK_POINTS = [
    (("chest pain",), 40),
    (("diabetes",), 25),
    (("breathing", "shortness of breath"), 30),
    (("high bp", "blood pressure"), 20),
    (("hypertension",), 15),
    (("fever",), 15),
]
RISK_AGE_CUT = 60
RISK_AGE_POINTS = 10
RISK_CAP = 100
DEFAULT_AGE = 55
DEFAULT_BP = 120

# Specialty choice: ordered (phrases, specialty).
SPECIALTY_RULES = [
    (("chest pain", "diabetes", "hypertension"), "Cardiology"),
    (("breathing", "shortness of breath"), "Pulmonology"),
    (("headache", "dizziness"), "Neurology"),
]
SPECIALTY_DEFAULT = "General Physician"

# Priority bands of the rule risk score: (lower bound, priority, recommendation).
PRIORITY_BANDS = [
    (90, "Emergency", "Seek emergency care immediately."),
    (60, "High", "Schedule an urgent appointment."),
]
PRIORITY_DEFAULT = ("Normal", "Schedule a routine consultation.")

# Chat explanation items: (phrases, name, points) in display order.
CHAT_XAI_ITEMS = [
    (("chest pain",), "Chest Pain", 40),
    (("shortness of breath", "breathing"), "Shortness of Breath", 30),
    (("high bp", "blood pressure"), "High Blood Pressure", 20),
    (("hypertension",), "Hypertension", 15),
    (("diabetes",), "Diabetes", 25),
    (("fever",), "Fever", 15),
]
# Rule-based fallback explanation items (no hypertension, no "breathing").
BASIC_XAI_ITEMS = [
    (("chest pain",), "Chest Pain", 40),
    (("shortness of breath",), "Shortness of Breath", 30),
    (("high bp", "blood pressure"), "High Blood Pressure", 20),
    (("diabetes",), "Diabetes", 25),
    (("fever",), "Fever", 15),
]
XAI_AGE_POINTS = 10

# Message routing words (healthcare vs general).
HEALTH_WORDS = ["medical", "health", "doctor", "hospital", "pain", "fever",
                "diabetes", "symptom", "chest", "breathing", "headache"]
# Hospital list request: "hospital" plus any of these words.
LIST_WORDS = ["list", "available", "show", "give", "nearby", "recommend"]
# Symptom signal phrases.
SYMPTOM_SIGNAL_WORDS = [
    "i have", "i am having", "symptom", "pain", "fever", "diabetes",
    "chest", "breathing", "shortness of breath", "headache", "dizziness",
    "cough", "blood pressure", "hypertension", "rash", "stomach",
]

# Hospitals in display order, and the preferred order per location.
HOSPITALS = [
    "Texas Health Frisco",
    "Baylor Scott & White Plano",
    "Medical City Plano",
    "Texas Health Plano",
    "Children's Medical Center Plano",
]
LOCATION_HOSPITALS = {
    "plano": ["Medical City Plano", "Baylor Scott & White Plano", "Texas Health Frisco"],
    "frisco": ["Texas Health Frisco", "Baylor Scott & White Plano", "Medical City Plano"],
}
DEFAULT_LOCATION = "plano"

# Symptom severity lists.
SEVERITY_CRITICAL = ["chest pain", "shortness of breath", "arm pain", "palpitations", "severe dizziness"]
SEVERITY_HIGH = ["breathing", "hypertension", "high blood pressure", "blurred vision", "sweating"]
SEVERITY_MEDIUM = ["headache", "dizziness", "diabetes", "frequent urination", "fever", "nausea",
                   "vomiting", "stomach pain"]

# Fallback ML risk score (crew risk stage when the model is unavailable).
FALLBACK_RISK_POINTS = [
    (("chest pain",), 40),
    (("shortness of breath",), 30),
    (("diabetes",), 25),
    (("hypertension", "high blood pressure"), 20),
]
FALLBACK_RISK_CAP = 99
FALLBACK_ML_CONFIDENCE = 0.7

# Health rules seed: id, keyword, category, specialty, priority, points, multiplier, explanation.
HEALTH_RULES = [
    (1, "chest pain", "symptom", "Cardiology", "High", 40, 3.0,
     "Chest pain detected, which may require heart-related evaluation."),
    (2, "shortness of breath", "symptom", "Cardiology", "High", 30, 2.5,
     "Shortness of breath detected, which increases urgency."),
    (3, "breathing", "symptom", "Pulmonology", "High", 30, 2.0,
     "Breathing difficulty detected."),
    (4, "diabetes", "history", "Endocrinology", "Medium", 20, 1.8,
     "Diabetes history detected."),
    (5, "high blood pressure", "history", "Cardiology", "Medium", 15, 1.6,
     "High blood pressure can increase heart risk."),
    (6, "hypertension", "history", "Cardiology", "Medium", 15, 1.6,
     "Hypertension can increase heart risk."),
    (7, "headache", "symptom", "Neurology", "Medium", 20, 1.3,
     "Headache detected. Neurology consultation may be useful."),
    (8, "rash", "symptom", "Dermatology", "Normal", 10, 1.1,
     "Rash detected. Dermatology consultation may be useful."),
    (9, "stomach pain", "symptom", "Gastroenterology", "Medium", 20, 1.3,
     "Stomach pain detected. Gastroenterology consultation may be useful."),
]
PRIORITY_RANK = {"Normal": 1, "Medium": 2, "High": 3}
NO_RULE_DEFAULT = ("General Physician", "Normal", 10, 0.10)
NO_RULE_EXPLANATION = "No matching health rule found. General physician consultation recommended."
RULE_CONFIDENCE_CAP = 0.95
BAYES_PRIOR = 0.10
BAYES_CAP = 0.95

# Knowledge graph: symptom nodes in node order, specialty nodes, edges (symptom, specialty, weight, risk).
KG_SYMPTOMS = [
    "chest pain", "shortness of breath", "palpitations", "arm pain",
    "dizziness", "headache", "nausea", "blurred vision",
    "diabetes", "hypertension", "high blood pressure", "obesity",
    "fever", "cough", "fatigue", "frequent urination",
    "skin rash", "itching", "stomach pain", "vomiting", "joint pain",
]
KG_SPECIALTIES = [
    "Cardiology", "Neurology", "Endocrinology", "Pulmonology",
    "Dermatology", "Gastroenterology", "General Physician",
]
KG_EDGES = [
    ("chest pain", "Cardiology", 40, "High"),
    ("shortness of breath", "Cardiology", 30, "High"),
    ("shortness of breath", "Pulmonology", 25, "High"),
    ("palpitations", "Cardiology", 25, "Medium"),
    ("arm pain", "Cardiology", 20, "Medium"),
    ("hypertension", "Cardiology", 15, "Medium"),
    ("high blood pressure", "Cardiology", 15, "Medium"),
    ("headache", "Neurology", 20, "Medium"),
    ("dizziness", "Neurology", 15, "Medium"),
    ("blurred vision", "Neurology", 15, "Medium"),
    ("diabetes", "Endocrinology", 20, "Medium"),
    ("frequent urination", "Endocrinology", 15, "Medium"),
    ("obesity", "Endocrinology", 10, "Low"),
    ("fever", "General Physician", 15, "Medium"),
    ("cough", "Pulmonology", 20, "Medium"),
    ("fatigue", "General Physician", 10, "Low"),
    ("skin rash", "Dermatology", 10, "Low"),
    ("itching", "Dermatology", 8, "Low"),
    ("stomach pain", "Gastroenterology", 20, "Medium"),
    ("nausea", "Gastroenterology", 12, "Low"),
    ("vomiting", "Gastroenterology", 15, "Medium"),
    ("joint pain", "General Physician", 10, "Low"),
]
KG_DEFAULT = ("General Physician", 10)
KG_NO_MATCH = "No specific condition matched → General Physician"

# Combined crew risk level and report urgency bands.
RISK_LEVEL_BANDS = [(60, "High"), (30, "Medium")]
RISK_LEVEL_DEFAULT = "Low"
REPORT_URGENCY_BANDS = [
    (85, "Emergency", "⚠️ Do NOT wait. Go to emergency services immediately."),
    (60, "Urgent", "Book the earliest available appointment today."),
    (30, "Soon", "Schedule within 2-3 days."),
]
REPORT_URGENCY_DEFAULT = ("Routine", "Routine consultation within 1-2 weeks.")
# Appointment urgency (mean of Bayesian and ML risk).
APPOINTMENT_URGENCY_BANDS = [
    (85, "Emergency", "immediate"),
    (60, "Urgent", "today"),
    (30, "Soon", "soon"),
]
APPOINTMENT_URGENCY_DEFAULT = ("Normal", "routine")
# Schedule offset per schedule type.
SCHEDULE_OFFSETS = {"immediate": "1 hour", "today": "2 hours", "soon": "2 days", "routine": "7 days"}

# Combined uncertainty bands.
UNCERTAINTY_BANDS = [
    (0.8, "Low", "High confidence diagnosis - proceed with standard protocol"),
    (0.6, "Medium", "Moderate confidence - recommend secondary confirmation"),
]
UNCERTAINTY_DEFAULT = ("High", "Low confidence - recommend specialist consultation")

# ML risk keywords and points (feature "symptom score", attribution).
ML_SYMPTOM_KEYWORDS = [
    ("chest pain", 40), ("shortness of breath", 30), ("breathing", 25), ("palpitations", 20),
    ("dizziness", 15), ("headache", 20), ("diabetes", 20), ("hypertension", 15),
    ("high blood pressure", 15), ("fever", 15), ("fatigue", 10), ("nausea", 10),
    ("stomach pain", 20), ("skin rash", 10), ("frequent urination", 15), ("arm pain", 20),
    ("sweating", 15), ("blurred vision", 15),
]
ATTRIBUTION_LIMIT = 8
ML_CLASSES = ["Low", "Medium", "High"]

# Multi-model clinical baseline: ordered (phrases, urgency, specialty).
CLINICAL_BASELINE = [
    (("chest pain", "arm pain", "palpitations", "pressure in chest", "severe chest"), "Emergency", "Cardiology"),
    (("shortness of breath", "breathing difficulty", "cannot breathe", "stridor"), "Emergency", "Pulmonology"),
    (("dizziness", "blurred vision", "slurred speech", "numbness"), "Urgent", "Neurology"),
    (("high blood pressure", "hypertension", "bp"), "Urgent", "Cardiology"),
    (("diabetes", "frequent urination", "blood sugar"), "Soon", "Endocrinology"),
    (("stomach pain", "nausea", "vomiting", "diarrhea"), "Soon", "Gastroenterology"),
    (("fever", "cough", "sore throat", "fatigue"), "Soon", "General Physician"),
]
CLINICAL_BASELINE_DEFAULT = ("Routine", "General Physician")
URGENCY_RANK = {"Emergency": 4, "Urgent": 3, "Soon": 2, "Routine": 1}
REPLY_URGENCY_KEYWORDS = ["emergency", "urgent", "soon", "routine"]
REPLY_SPECIALTY_KEYWORDS = ["cardiology", "pulmonology", "neurology", "endocrinology",
                            "gastroenterology", "general physician"]
MISSING_VOTE = ("Soon", "General Physician")
MODELS = [("phi", 1), ("qwen", 2), ("deepseek", 3)]

# Booking triage (agent form): ordered checks.
TRIAGE_DEFAULT = ("General Physician", "Normal", "General consultation recommended.")

# Knowledge sentences of the overlap search, in order.
KB_SENTENCES = [
    "Chest pain with diabetes may indicate elevated cardiovascular risk.",
    "Breathing difficulty with chest pain may require urgent evaluation.",
    "High blood pressure can increase the risk of heart disease.",
    "Fever and cough may indicate infection or respiratory illness.",
    "Patients with severe chest pain should seek immediate medical care.",
]
OVERLAP_TOP_K = 3
RETRIEVAL_TOP_K = 3
RETRIEVAL_TEXT_CHARS = 500
RAG_SNIPPET_CHARS = 200
NO_GUIDELINE = "No guideline found."

# Stored chat rows: response fields left out, and the patient of unnamed rows.
CHAT_DROPPED_FIELDS = ["xai_details", "rag_medical_context", "kg_relationships"]
DEFAULT_PATIENT = "Patient"

# Image checks.
IMAGE_MAX_BYTES = 20 * 1024 * 1024
IMAGE_TYPES = ["image/jpeg", "image/png", "image/jpg", "image/webp"]
IMAGE_MODALITIES = ["xray", "mri", "ct", "skin"]
IMAGE_DEFAULT_MODALITY = "xray"
IMAGE_DARK, IMAGE_BRIGHT, IMAGE_CONTRAST = 60, 200, 90
IMAGE_CONF_BASE, IMAGE_CONF_SCALE, IMAGE_CONF_CAP = 0.62, 400.0, 0.95
CLASS_SCORE_CUT = 0.60

# Spark ML risk model.
SPARK_ML_FEATURES = ["age", "chest_pain", "diabetes", "hypertension", "shortness_of_breath", "blood_pressure"]
SPARK_ML_LABELS = {0: "Low Risk", 1: "Medium Risk", 2: "High Risk", 3: "Emergency"}
RF_TREES, RF_DEPTH, RF_SEED = 50, 5, 42
SPLIT_TRAIN_FRACTION = 0.8

# Calendar: slot length and default time.
SLOT_MINUTES = 30
DEFAULT_SLOT_TIME = "10:00 AM"

# --- end of FIXED VALUES ----------------------------------------------------
DISCLAIMER = "This is not a medical diagnosis. For emergencies, call 911 immediately."
