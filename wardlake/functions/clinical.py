"""Per-case clinical rules as Column expressions.

Each function takes Columns and returns a Column, so a whole table of cases is
scored in one projection inside whole-stage codegen.  ``sql_*`` twins emit the
same rule as DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import rules as R
from wardlake.functions.rules import q


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# FIXED VALUES: the characters Python's str.strip() removes by default.
PY_WHITESPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def pystrip(c: Column) -> Column:
    """Trim leading/trailing whitespace like Python's str.strip() (a
    character-set trim, no regular expression)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def sql_pystrip(c: str) -> str:
    return f"trim({c}, '{PY_WHITESPACE}')"


def nonblank(c: Column) -> Column:
    """NULL for NULL or '' (Python truthiness of a str)."""
    return F.when(c != "", c)


def list_text(c) -> Column:
    """Text of a ', '-separated list re-joined with spaces, lowered
    (what ``" ".join(text.split(", ")).lower()`` gives)."""
    return F.lower(F.replace(F.coalesce(_c(c), F.lit("")), F.lit(", "), F.lit(" ")))


def sql_list_text(c: str) -> str:
    return f"lower(replace(coalesce({c}, ''), ', ', ' '))"


# H1 -------------------------------------------------------------------------
def infer_disease(symptoms, specialty=None) -> Column:
    text = F.lower(F.coalesce(_c(symptoms), F.lit("")))
    fallback = F.lit(K.DISEASE_DEFAULT) if specialty is None else F.coalesce(nonblank(_c(specialty)), F.lit(K.DISEASE_DEFAULT))
    return R.first_match(text, K.DISEASE_RULES, fallback)


def sql_infer_disease(symptoms: str, specialty: str | None = None) -> str:
    text = f"lower(coalesce({symptoms}, ''))"
    fallback = q(K.DISEASE_DEFAULT) if specialty is None else f"coalesce(nullif({specialty}, ''), {q(K.DISEASE_DEFAULT)})"
    return R.sql_first_match(text, K.DISEASE_RULES, fallback)


# H2 -------------------------------------------------------------------------
def risk_score(symptoms, age=None) -> Column:
    text = F.lower(F.coalesce(_c(symptoms), F.lit("")))
    a = F.coalesce(_c(age), F.lit(K.DEFAULT_AGE)) if age is not None else F.lit(K.DEFAULT_AGE)
    raw = R.points(text, K.RISK_POINTS) + F.when(a >= K.RISK_AGE_CUT, F.lit(K.RISK_AGE_POINTS)).otherwise(F.lit(0))
    return F.least(raw, F.lit(K.RISK_CAP)).cast("int")


def sql_risk_score(symptoms: str, age: str | None = None) -> str:
    text = f"lower(coalesce({symptoms}, ''))"
    a = f"coalesce({age}, {K.DEFAULT_AGE})" if age else str(K.DEFAULT_AGE)
    return (f"CAST(least({R.sql_points(text, K.RISK_POINTS)} + (CASE WHEN {a} >= {K.RISK_AGE_CUT} "
            f"THEN {K.RISK_AGE_POINTS} ELSE 0 END), {K.RISK_CAP}) AS INTEGER)")


# H3 -------------------------------------------------------------------------
def choose_specialty(symptoms) -> Column:
    text = F.lower(F.coalesce(_c(symptoms), F.lit("")))
    return R.first_match(text, K.SPECIALTY_RULES, F.lit(K.SPECIALTY_DEFAULT))


def sql_choose_specialty(symptoms: str) -> str:
    return R.sql_first_match(f"lower(coalesce({symptoms}, ''))", K.SPECIALTY_RULES, q(K.SPECIALTY_DEFAULT))


# H4 -------------------------------------------------------------------------
def risk_priority(score) -> Column:
    return R.band(_c(score), K.PRIORITY_BANDS, K.PRIORITY_DEFAULT[0], pick=1)


def risk_recommendation(score) -> Column:
    return R.band(_c(score), K.PRIORITY_BANDS, K.PRIORITY_DEFAULT[1], pick=2)


def sql_risk_priority(score: str) -> str:
    return R.sql_band(score, K.PRIORITY_BANDS, K.PRIORITY_DEFAULT[0], pick=1)


def sql_risk_recommendation(score: str) -> str:
    return R.sql_band(score, K.PRIORITY_BANDS, K.PRIORITY_DEFAULT[1], pick=2)


# H5 / H6 ----------------------------------------------------------------------
def xai_items(symptoms, age=None, items=K.CHAT_XAI_ITEMS) -> Column:
    """array<struct<name string, points int>> in display order."""
    text = F.lower(F.coalesce(_c(symptoms), F.lit("")))
    a = F.coalesce(_c(age), F.lit(K.DEFAULT_AGE)) if age is not None else F.lit(K.DEFAULT_AGE)
    entries = [
        F.when(R.any_contains(text, phrases), F.struct(F.lit(name).alias("name"), F.lit(pts).alias("points")))
        for phrases, name, pts in items
    ]
    entries.append(F.when(a >= K.RISK_AGE_CUT, F.struct(
        F.concat(F.lit("Age ("), a.cast("string"), F.lit(")")).alias("name"),
        F.lit(K.XAI_AGE_POINTS).alias("points"))))
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def sql_xai_items(symptoms: str, age: str | None = None, items=K.CHAT_XAI_ITEMS) -> str:
    """The explanation list, as SQL."""
    text = f"lower(coalesce({symptoms}, ''))"
    a = f"coalesce({age}, {K.DEFAULT_AGE})" if age else str(K.DEFAULT_AGE)
    entries = [f"CASE WHEN {R.sql_any_contains(text, p)} THEN {{'name': {q(n)}, 'points': {pts}}} END"
               for p, n, pts in items]
    entries.append(f"CASE WHEN {a} >= {K.RISK_AGE_CUT} THEN {{'name': 'Age (' || CAST({a} AS VARCHAR) || ')', "
                   f"'points': {K.XAI_AGE_POINTS}}} END")
    return f"list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL)"


def sql_xai_items_rows(symptoms: str, age: str | None, items, key: str, source: str) -> str:
    """Rows (key, item_ord, name, points) of the explanation list, as SQL."""
    arr = sql_xai_items(symptoms, age, items)
    return (f"SELECT {key}, CAST(i AS INTEGER) AS item_ord, arr[i].name AS name, CAST(arr[i].points AS INTEGER) AS points "
            f"FROM (SELECT {key}, {arr} AS arr FROM {source}) s, range(1, len(arr) + 1) r(i)")


# H8-H12 -----------------------------------------------------------------------
def route_message(message) -> Column:
    text = F.lower(F.coalesce(_c(message), F.lit("")))
    return F.when(R.any_contains(text, K.HEALTH_WORDS), F.lit("healthcare")).otherwise(F.lit("general"))


def sql_route_message(message: str) -> str:
    text = f"lower(coalesce({message}, ''))"
    return f"(CASE WHEN {R.sql_any_contains(text, K.HEALTH_WORDS)} THEN 'healthcare' ELSE 'general' END)"


def is_list_request(message) -> Column:
    text = F.lower(F.coalesce(_c(message), F.lit("")))
    return text.contains("hospital") & R.any_contains(text, K.LIST_WORDS)


def sql_is_list_request(message: str) -> str:
    text = f"lower(coalesce({message}, ''))"
    return f"(contains({text}, 'hospital') AND {R.sql_any_contains(text, K.LIST_WORDS)})"


def has_symptom_signal(message) -> Column:
    return R.any_contains(F.lower(F.coalesce(_c(message), F.lit(""))), K.SYMPTOM_SIGNAL_WORDS)


def sql_has_symptom_signal(message: str) -> str:
    return R.sql_any_contains(f"lower(coalesce({message}, ''))", K.SYMPTOM_SIGNAL_WORDS)


def location_from_message(message) -> Column:
    text = F.lower(F.coalesce(_c(message), F.lit("")))
    return R.first_match(text, [((loc,), loc) for loc in K.LOCATION_HOSPITALS], F.lit(None).cast("string"))


def sql_location_from_message(message: str) -> str:
    return R.sql_first_match(f"lower(coalesce({message}, ''))", [((loc,), loc) for loc in K.LOCATION_HOSPITALS],
                             "CAST(NULL AS VARCHAR)")


def resolve_hospital_name(message) -> Column:
    text = F.lower(pystrip(F.coalesce(_c(message), F.lit(""))))
    expr = None
    for h in K.HOSPITALS:
        cond = text == F.lit(h.lower())
        expr = F.when(cond, F.lit(h)) if expr is None else expr.when(cond, F.lit(h))
    return expr.otherwise(F.lit(None).cast("string"))


def sql_resolve_hospital_name(message: str) -> str:
    text = f"lower({sql_pystrip(f'coalesce({message}, {chr(39)}{chr(39)})')})"
    whens = " ".join(f"WHEN {text} = {q(h.lower())} THEN {q(h)}" for h in K.HOSPITALS)
    return f"(CASE {whens} ELSE CAST(NULL AS VARCHAR) END)"


# H13 ------------------------------------------------------------------------------
def severity_lists(symptoms, history) -> dict[str, Column]:
    text = R.lower_join(symptoms, history)
    crit, high, med = (R.found(text, K.SEVERITY_CRITICAL), R.found(text, K.SEVERITY_HIGH),
                       R.found(text, K.SEVERITY_MEDIUM))
    sev = (F.when(F.size(crit) > 0, "Critical").when(F.size(high) > 0, "High")
           .when(F.size(med) > 0, "Medium").otherwise("Low"))
    return {"critical": crit, "high": high, "medium": med, "severity": sev}


def severity_text(symptoms, history) -> dict[str, Column]:
    """H13 without arrays: each list as ', '-joined text (concat_ws skips the
    phrases not found) and the severity as one CASE."""
    text = R.lower_join(symptoms, history)
    joined = {k: F.concat_ws(", ", *[F.when(text.contains(p), F.lit(p)) for p in lst])
              for k, lst in (("critical", K.SEVERITY_CRITICAL), ("high", K.SEVERITY_HIGH), ("medium", K.SEVERITY_MEDIUM))}
    sev = (F.when(R.any_contains(text, K.SEVERITY_CRITICAL), "Critical").when(R.any_contains(text, K.SEVERITY_HIGH), "High")
           .when(R.any_contains(text, K.SEVERITY_MEDIUM), "Medium").otherwise("Low"))
    return {**joined, "severity": sev}


def sql_severity_lists(symptoms: str, history: str) -> dict[str, str]:
    text = R.sql_lower_join(symptoms, history)
    crit, high, med = (R.sql_found(text, K.SEVERITY_CRITICAL), R.sql_found(text, K.SEVERITY_HIGH),
                       R.sql_found(text, K.SEVERITY_MEDIUM))
    sev = (f"(CASE WHEN len({crit}) > 0 THEN 'Critical' WHEN len({high}) > 0 THEN 'High' "
           f"WHEN len({med}) > 0 THEN 'Medium' ELSE 'Low' END)")
    return {"critical": crit, "high": high, "medium": med, "severity": sev}


# H14 ------------------------------------------------------------------------------
def fallback_risk_pct(symptoms) -> Column:
    text = F.lower(F.coalesce(_c(symptoms), F.lit("")))
    return F.least(R.points(text, K.FALLBACK_RISK_POINTS), F.lit(K.FALLBACK_RISK_CAP)).cast("int")


def sql_fallback_risk_pct(symptoms: str) -> str:
    text = f"lower(coalesce({symptoms}, ''))"
    return f"CAST(least({R.sql_points(text, K.FALLBACK_RISK_POINTS)}, {K.FALLBACK_RISK_CAP}) AS INTEGER)"


def risk_level(pct) -> Column:
    return R.band(_c(pct), K.RISK_LEVEL_BANDS, K.RISK_LEVEL_DEFAULT)


def sql_risk_level(pct: str) -> str:
    return R.sql_band(pct, K.RISK_LEVEL_BANDS, K.RISK_LEVEL_DEFAULT)


# H16 / H17 ------------------------------------------------------------------------
def report_urgency(pct) -> Column:
    return R.band(_c(pct), K.REPORT_URGENCY_BANDS, K.REPORT_URGENCY_DEFAULT[0], pick=1)


def report_recommendation(pct) -> Column:
    return R.band(_c(pct), K.REPORT_URGENCY_BANDS, K.REPORT_URGENCY_DEFAULT[1], pick=2)


def sql_report_urgency(pct: str) -> str:
    return R.sql_band(pct, K.REPORT_URGENCY_BANDS, K.REPORT_URGENCY_DEFAULT[0], pick=1)


def sql_report_recommendation(pct: str) -> str:
    return R.sql_band(pct, K.REPORT_URGENCY_BANDS, K.REPORT_URGENCY_DEFAULT[1], pick=2)


def appointment_urgency(avg_pct) -> Column:
    return R.band(_c(avg_pct), K.APPOINTMENT_URGENCY_BANDS, K.APPOINTMENT_URGENCY_DEFAULT[0], pick=1)


def schedule_type(avg_pct) -> Column:
    return R.band(_c(avg_pct), K.APPOINTMENT_URGENCY_BANDS, K.APPOINTMENT_URGENCY_DEFAULT[1], pick=2)


def sql_appointment_urgency(avg_pct: str) -> str:
    return R.sql_band(avg_pct, K.APPOINTMENT_URGENCY_BANDS, K.APPOINTMENT_URGENCY_DEFAULT[0], pick=1)


def sql_schedule_type(avg_pct: str) -> str:
    return R.sql_band(avg_pct, K.APPOINTMENT_URGENCY_BANDS, K.APPOINTMENT_URGENCY_DEFAULT[1], pick=2)


# H18 ------------------------------------------------------------------------------
def uncertainty_level(conf) -> Column:
    return R.band(_c(conf), K.UNCERTAINTY_BANDS, K.UNCERTAINTY_DEFAULT[0], pick=1)


def treatment_recommendation(conf) -> Column:
    return R.band(_c(conf), K.UNCERTAINTY_BANDS, K.UNCERTAINTY_DEFAULT[1], pick=2)


def sql_uncertainty_level(conf: str) -> str:
    return R.sql_band(conf, K.UNCERTAINTY_BANDS, K.UNCERTAINTY_DEFAULT[0], pick=1)


def sql_treatment_recommendation(conf: str) -> str:
    return R.sql_band(conf, K.UNCERTAINTY_BANDS, K.UNCERTAINTY_DEFAULT[1], pick=2)


# H20 / H21 / H22 ----------------------------------------------------------------------
FEATURE_NAMES = ["age", "bp", "hr", "cholesterol", "symptom_score", "chest_pain", "diabetes", "hypertension",
                 "breathing", "age_risk", "bp_risk", "chol_risk", "hr_risk"]


def risk_feature_columns(text: Column, age, bp, hr, chol) -> list[Column]:
    """The 13 model features; ``text`` is the lowered symptoms+history text."""
    a, b, h, c = (_c(age).cast("double"), _c(bp).cast("double"), _c(hr).cast("double"), _c(chol).cast("double"))
    score = R.points(text, [((k,), p) for k, p in K.ML_SYMPTOM_KEYWORDS]).cast("double")
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    cols = [
        a, b, h, c, score,
        flag(text.contains("chest pain")),
        flag(text.contains("diabetes")),
        flag(text.contains("hypertension") | text.contains("high blood pressure")),
        flag(text.contains("shortness of breath") | text.contains("breathing")),
        F.greatest(F.lit(0.0), (a - 40) / 10),
        F.greatest(F.lit(0.0), (b - 120) / 10),
        F.greatest(F.lit(0.0), (c - 200) / 20),
        F.abs(h - 72) / 20,
    ]
    return [col.alias(n) for col, n in zip(cols, FEATURE_NAMES)]


def sql_risk_feature_columns(text: str, age: str, bp: str, hr: str, chol: str) -> list[str]:
    a, b, h, c = (f"CAST({age} AS DOUBLE)", f"CAST({bp} AS DOUBLE)", f"CAST({hr} AS DOUBLE)", f"CAST({chol} AS DOUBLE)")
    score = f"CAST({R.sql_points(text, [((k,), p) for k, p in K.ML_SYMPTOM_KEYWORDS])} AS DOUBLE)"
    flag = lambda cond: f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE)"
    cols = [
        a, b, h, c, score,
        flag(f"contains({text}, 'chest pain')"),
        flag(f"contains({text}, 'diabetes')"),
        flag(f"(contains({text}, 'hypertension') OR contains({text}, 'high blood pressure'))"),
        flag(f"(contains({text}, 'shortness of breath') OR contains({text}, 'breathing'))"),
        f"greatest(0.0, ({a} - 40) / 10)",
        f"greatest(0.0, ({b} - 120) / 10)",
        f"greatest(0.0, ({c} - 200) / 20)",
        f"abs({h} - 72) / 20",
    ]
    return [f"{col} AS {n}" for col, n in zip(cols, FEATURE_NAMES)]


def risk_label(score) -> Column:
    s = _c(score)
    return F.when(s >= 70, 2).when(s >= 40, 1).otherwise(0).cast("int")


def sql_risk_label(score: str) -> str:
    return f"CAST(CASE WHEN {score} >= 70 THEN 2 WHEN {score} >= 40 THEN 1 ELSE 0 END AS INTEGER)"


def _attribution_keywords():
    # stable sort by points descending, keeps list order on ties
    return sorted(K.ML_SYMPTOM_KEYWORDS, key=lambda kv: -kv[1])


def risk_attribution(text: Column, age, bp, chol) -> Column:
    """array<struct<name, points>>: keywords by points, then age/bp/cholesterol; first 8."""
    a, b, c = _c(age), _c(bp), _c(chol)
    entries = [F.when(text.contains(k), F.struct(F.lit(k.title()).alias("name"), F.lit(p).alias("points")))
               for k, p in _attribution_keywords()]
    entries += [
        F.when(a >= 60, F.struct(F.concat(F.lit("Age ("), a.cast("string"), F.lit(")")).alias("name"),
                                 F.least(F.floor((a - 40) / 2), F.lit(20)).cast("int").alias("points"))),
        F.when(b >= 130, F.struct(F.concat(F.lit("High BP ("), b.cast("string"), F.lit(")")).alias("name"),
                                  F.least(F.floor((b - 120) / 2), F.lit(15)).cast("int").alias("points"))),
        F.when(c >= 200, F.struct(F.concat(F.lit("High Cholesterol ("), c.cast("string"), F.lit(")")).alias("name"),
                                  F.least(F.floor((c - 180) / 5), F.lit(12)).cast("int").alias("points"))),
    ]
    return F.slice(F.filter(F.array(*entries), lambda x: x.isNotNull()), 1, K.ATTRIBUTION_LIMIT)


def sql_risk_attribution(text: str, age: str, bp: str, chol: str) -> str:
    entries = [f"CASE WHEN contains({text}, {q(k)}) THEN {{'name': {q(k.title())}, 'points': {p}}} END"
               for k, p in _attribution_keywords()]
    entries += [
        f"CASE WHEN {age} >= 60 THEN {{'name': 'Age (' || CAST({age} AS VARCHAR) || ')', "
        f"'points': CAST(least(floor(({age} - 40) / 2), 20) AS INTEGER)}} END",
        f"CASE WHEN {bp} >= 130 THEN {{'name': 'High BP (' || CAST({bp} AS VARCHAR) || ')', "
        f"'points': CAST(least(floor(({bp} - 120) / 2), 15) AS INTEGER)}} END",
        f"CASE WHEN {chol} >= 200 THEN {{'name': 'High Cholesterol (' || CAST({chol} AS VARCHAR) || ')', "
        f"'points': CAST(least(floor(({chol} - 180) / 5), 12) AS INTEGER)}} END",
    ]
    return f"list_slice(list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL), 1, {K.ATTRIBUTION_LIMIT})"


# H23 ------------------------------------------------------------------------------
def clinical_baseline(symptoms) -> tuple[Column, Column]:
    text = F.lower(F.coalesce(_c(symptoms), F.lit("")))
    urg = R.first_match(text, [(p, u) for p, u, _ in K.CLINICAL_BASELINE], F.lit(K.CLINICAL_BASELINE_DEFAULT[0]))
    spec = R.first_match(text, [(p, s) for p, _, s in K.CLINICAL_BASELINE], F.lit(K.CLINICAL_BASELINE_DEFAULT[1]))
    return urg, spec


def sql_clinical_baseline(symptoms: str) -> tuple[str, str]:
    text = f"lower(coalesce({symptoms}, ''))"
    urg = R.sql_first_match(text, [(p, u) for p, u, _ in K.CLINICAL_BASELINE], q(K.CLINICAL_BASELINE_DEFAULT[0]))
    spec = R.sql_first_match(text, [(p, s) for p, _, s in K.CLINICAL_BASELINE], q(K.CLINICAL_BASELINE_DEFAULT[1]))
    return urg, spec


# H24 ------------------------------------------------------------------------------
_TRIAGE = [
    ("symptoms", ("chest pain", "shortness of breath"), "Cardiology", "High", "Chest pain or breathing issue detected."),
    ("history", ("diabetes",), "Endocrinology", "Medium", "Diabetes history detected."),
    ("symptoms", ("headache",), "Neurology", "Medium", "Headache detected."),
]


def patient_triage(symptoms, history) -> tuple[Column, Column, Column]:
    texts = {"symptoms": list_text(symptoms), "history": list_text(history)}
    out = []
    for pick, default in ((2, K.TRIAGE_DEFAULT[0]), (3, K.TRIAGE_DEFAULT[1]), (4, K.TRIAGE_DEFAULT[2])):
        expr = None
        for rule in _TRIAGE:
            cond = R.any_contains(texts[rule[0]], rule[1])
            expr = F.when(cond, F.lit(rule[pick])) if expr is None else expr.when(cond, F.lit(rule[pick]))
        out.append(expr.otherwise(F.lit(default)))
    return tuple(out)


def sql_patient_triage(symptoms: str, history: str) -> tuple[str, str, str]:
    texts = {"symptoms": sql_list_text(symptoms), "history": sql_list_text(history)}
    out = []
    for pick, default in ((2, K.TRIAGE_DEFAULT[0]), (3, K.TRIAGE_DEFAULT[1]), (4, K.TRIAGE_DEFAULT[2])):
        whens = " ".join(f"WHEN {R.sql_any_contains(texts[r[0]], r[1])} THEN {q(r[pick])}" for r in _TRIAGE)
        out.append(f"(CASE {whens} ELSE {q(default)} END)")
    return tuple(out)


# H34 / H35 ------------------------------------------------------------------------
def image_modality(modality) -> Column:
    m = F.lower(pystrip(F.coalesce(_c(modality), F.lit(""))))
    return F.when(m.isin(*K.IMAGE_MODALITIES), m).otherwise(F.lit(K.IMAGE_DEFAULT_MODALITY))


def image_abnormal(brightness, contrast) -> Column:
    b, c = _c(brightness), _c(contrast)
    return (b < K.IMAGE_DARK) | (b > K.IMAGE_BRIGHT) | (c > K.IMAGE_CONTRAST)


def image_confidence(brightness) -> Column:
    b = _c(brightness).cast("double")
    return F.least(F.lit(K.IMAGE_CONF_BASE) + F.abs(b - 128) / K.IMAGE_CONF_SCALE, F.lit(K.IMAGE_CONF_CAP))


def class_decision(normal, abnormal, inconclusive, cut=None) -> tuple[Column, Column]:
    """(max score, decision): argmax of the three class scores (first
    class wins ties); below ``cut`` the result is 'inconclusive'."""
    cut = K.CLASS_SCORE_CUT if cut is None else cut
    n, a, i = _c(normal), _c(abnormal), _c(inconclusive)
    mx = F.greatest(n, a, i)
    dec = (F.when(mx < cut, "inconclusive").when(n == mx, "normal").when(a == mx, "abnormal")
           .otherwise("inconclusive"))
    return mx, dec


# H36 ------------------------------------------------------------------------------
def final_risk(crew_risk, rule_risk) -> Column:
    """crew risk, or the rule risk when the crew risk is 0 or missing; cap 100; truncated."""
    cr = _c(crew_risk).cast("double")
    chosen = F.when(cr.isNull() | (cr == 0), _c(rule_risk).cast("double")).otherwise(cr)
    return F.least(chosen, F.lit(100.0)).cast("int")


def sql_final_risk(crew_risk: str, rule_risk: str) -> str:
    cr = f"CAST({crew_risk} AS DOUBLE)"
    return (f"CAST(trunc(least(CASE WHEN {cr} IS NULL OR {cr} = 0 THEN CAST({rule_risk} AS DOUBLE) ELSE {cr} END, 100.0)) "
            f"AS INTEGER)")


# H37 ------------------------------------------------------------------------------
def split_list(text, blank_default: list[str] | None) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    default = F.array(*[F.lit(x) for x in blank_default]) if blank_default else F.array().cast("array<string>")
    return F.when(t == "", default).otherwise(F.split(t, ", ", -1))
