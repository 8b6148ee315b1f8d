"""Per-case rule queries (H1-H24, H34-H37): one projection each, map-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.functions import rules as R
from wardlake.functions import timefn as T
from wardlake.plans.registry import register
from wardlake.sources import fixtures as V


def _sql_spec():
    return C.sql_choose_specialty("symptoms")


@register("infer_disease", lambda: f"""
SELECT case_id, specialty, {C.sql_infer_disease('symptoms', 'specialty')} AS disease
FROM (SELECT case_id, symptoms, {_sql_spec()} AS specialty FROM cases_v) c""")
def infer_disease(spark, sf):
    c = V.cases_v(spark, sf)
    spec = C.choose_specialty(F.col("symptoms"))
    return c.select("case_id", spec.alias("specialty"), C.infer_disease(F.col("symptoms"), spec).alias("disease"))


@register("risk_score_rules", lambda: f"""
SELECT case_id, age, {C.sql_risk_score('symptoms', 'age')} AS risk_score FROM cases_v""")
def risk_score_rules(spark, sf):
    c = V.cases_v(spark, sf)
    return c.select("case_id", "age", C.risk_score(F.col("symptoms"), F.col("age")).alias("risk_score"))


@register("choose_specialty", lambda: f"SELECT case_id, {_sql_spec()} AS specialty FROM cases_v")
def choose_specialty(spark, sf):
    return V.cases_v(spark, sf).select("case_id", C.choose_specialty(F.col("symptoms")).alias("specialty"))


@register("risk_priority", lambda: f"""
SELECT case_id, risk_score, {C.sql_risk_priority('risk_score')} AS priority,
       {C.sql_risk_recommendation('risk_score')} AS recommendation
FROM (SELECT case_id, {C.sql_risk_score('symptoms', 'age')} AS risk_score FROM cases_v) c""")
def risk_priority(spark, sf):
    c = V.cases_v(spark, sf).select("case_id", C.risk_score(F.col("symptoms"), F.col("age")).alias("risk_score"))
    return c.select("case_id", "risk_score", C.risk_priority(F.col("risk_score")).alias("priority"),
                    C.risk_recommendation(F.col("risk_score")).alias("recommendation"))


def _explode_items(df, key: str, items_col):
    return (df.select(key, F.posexplode(items_col).alias("pos", "item"))
            .select(key, (F.col("pos") + 1).cast("int").alias("item_ord"), F.col("item.name").alias("name"),
                    F.col("item.points").cast("int").alias("points")))


@register("xai_details", lambda: C.sql_xai_items_rows("symptoms", "age", K.CHAT_XAI_ITEMS, "case_id", "cases_v"))
def xai_details(spark, sf):
    c = V.cases_v(spark, sf)
    return _explode_items(c, "case_id", C.xai_items(F.col("symptoms"), F.col("age"), K.CHAT_XAI_ITEMS))


@register("xai_details_basic", lambda: C.sql_xai_items_rows("symptoms", "age", K.BASIC_XAI_ITEMS, "case_id", "cases_v"))
def xai_details_basic(spark, sf):
    c = V.cases_v(spark, sf)
    return _explode_items(c, "case_id", C.xai_items(F.col("symptoms"), F.col("age"), K.BASIC_XAI_ITEMS))


@register("route_messages", lambda: f"""
SELECT session_id, turn, {C.sql_route_message('message')} AS route FROM messages_v""")
def route_messages(spark, sf):
    m = V.messages_v(spark, sf)
    return m.select("session_id", "turn", C.route_message(F.col("message")).alias("route"))


@register("message_signals", lambda: f"""
SELECT session_id, turn, {C.sql_is_list_request('message')} AS list_request,
       {C.sql_has_symptom_signal('message')} AS symptom_signal,
       {C.sql_location_from_message('message')} AS location,
       {C.sql_resolve_hospital_name('message')} AS hospital_name
FROM messages_v""")
def message_signals(spark, sf):
    m = V.messages_v(spark, sf)
    msg = F.col("message")
    return m.select("session_id", "turn", C.is_list_request(msg).alias("list_request"),
                    C.has_symptom_signal(msg).alias("symptom_signal"),
                    C.location_from_message(msg).alias("location"),
                    C.resolve_hospital_name(msg).alias("hospital_name"))


def _sev_sql():
    s = C.sql_severity_lists("symptoms", "history")
    return (f"SELECT case_id, {s['severity']} AS severity, array_to_string({s['critical']}, ', ') AS critical, "
            f"array_to_string({s['high']}, ', ') AS high, array_to_string({s['medium']}, ', ') AS medium FROM cases_v")


@register("symptom_severity", _sev_sql)
def symptom_severity(spark, sf):
    c = V.cases_v(spark, sf)
    s = C.severity_text(F.col("symptoms"), F.col("history"))
    return c.select("case_id", *[s[k].alias(k) for k in ("severity", "critical", "high", "medium")])


@register("risk_score_fallback", lambda: f"""
SELECT case_id, fallback_risk, {C.sql_risk_level('fallback_risk')} AS fallback_level
FROM (SELECT case_id, {C.sql_fallback_risk_pct('symptoms')} AS fallback_risk FROM cases_v) c""")
def risk_score_fallback(spark, sf):
    c = V.cases_v(spark, sf).select("case_id", C.fallback_risk_pct(F.col("symptoms")).alias("fallback_risk"))
    return c.select("case_id", "fallback_risk", C.risk_level(F.col("fallback_risk")).alias("fallback_level"))


@register("clinical_baseline", lambda: "SELECT case_id, {0} AS urgency, {1} AS specialty FROM cases_v".format(
    *C.sql_clinical_baseline("symptoms")))
def clinical_baseline(spark, sf):
    u, s = C.clinical_baseline(F.col("symptoms"))
    return V.cases_v(spark, sf).select("case_id", u.alias("urgency"), s.alias("specialty"))


@register("patient_triage", lambda: "SELECT case_id, {0} AS specialty, {1} AS priority, {2} AS reason FROM cases_v".format(
    *C.sql_patient_triage("symptoms", "history")))
def patient_triage(spark, sf):
    sp, pr, rs = C.patient_triage(F.col("symptoms"), F.col("history"))
    return V.cases_v(spark, sf).select("case_id", sp.alias("specialty"), pr.alias("priority"), rs.alias("reason"))


def _features_text():
    return C.list_text(F.concat_ws(", ", F.col("symptoms"), F.col("history")))


def _sql_features_text():
    return C.sql_list_text("concat_ws(', ', symptoms, history)")


@register("risk_features", lambda: "SELECT case_id, {0} FROM cases_v".format(
    ", ".join(C.sql_risk_feature_columns(_sql_features_text(), "age", "bp", "heart_rate", "cholesterol"))))
def risk_features(spark, sf):
    c = V.cases_v(spark, sf)
    return c.select("case_id", *C.risk_feature_columns(_features_text(), "age", "bp", "heart_rate", "cholesterol"))


@register("risk_label", lambda: f"""
SELECT case_id, risk_score, {C.sql_risk_label('risk_score')} AS label
FROM (SELECT case_id, {C.sql_risk_score('symptoms', 'age')} AS risk_score FROM cases_v) c""")
def risk_label(spark, sf):
    c = V.cases_v(spark, sf).select("case_id", C.risk_score(F.col("symptoms"), F.col("age")).alias("risk_score"))
    return c.select("case_id", "risk_score", C.risk_label(F.col("risk_score")).alias("label"))


@register("risk_attribution", lambda: f"""
SELECT case_id, CAST(i AS INTEGER) AS item_ord, arr[i].name AS name, CAST(arr[i].points AS INTEGER) AS points
FROM (SELECT case_id, {C.sql_risk_attribution(C.sql_list_text('symptoms'), 'age', 'bp', 'cholesterol')} AS arr
      FROM cases_v) s, range(1, len(arr) + 1) r(i)""")
def risk_attribution(spark, sf):
    c = V.cases_v(spark, sf)
    items = C.risk_attribution(C.list_text(F.col("symptoms")), F.col("age"), F.col("bp"), F.col("cholesterol"))
    return _explode_items(c, "case_id", items)


@register("image_flags", lambda: f"""
SELECT image_id,
       CASE WHEN lower({C.sql_pystrip('modality')}) IN ({', '.join(R.q(m) for m in K.IMAGE_MODALITIES)})
            THEN lower({C.sql_pystrip('modality')}) ELSE '{K.IMAGE_DEFAULT_MODALITY}' END AS modality,
       CASE WHEN brightness < {K.IMAGE_DARK} OR brightness > {K.IMAGE_BRIGHT} OR contrast > {K.IMAGE_CONTRAST}
            THEN 'abnormal' ELSE 'normal' END AS category,
       least({K.IMAGE_CONF_BASE} + abs(CAST(brightness AS DOUBLE) - 128) / {K.IMAGE_CONF_SCALE}, {K.IMAGE_CONF_CAP})
         AS confidence
FROM image_metrics_v""")
def image_flags(spark, sf):
    m = V.image_metrics_v(spark, sf)
    return m.select(
        "image_id", C.image_modality(F.col("modality")).alias("modality"),
        F.when(C.image_abnormal(F.col("brightness"), F.col("contrast")), "abnormal").otherwise("normal").alias("category"),
        C.image_confidence(F.col("brightness")).alias("confidence"),
    )


_CLASSES = ["normal", "abnormal", "inconclusive"]
_CUT_MILLI = int(K.CLASS_SCORE_CUT * 1000)


@register("score_decision", f"""
SELECT image_id, max_milli,
       CASE WHEN max_milli < {_CUT_MILLI} THEN 'inconclusive'
            WHEN normal_milli = max_milli THEN 'normal'
            WHEN abnormal_milli = max_milli THEN 'abnormal' ELSE 'inconclusive' END AS decision
FROM (SELECT image_id, normal_milli, abnormal_milli,
             greatest(normal_milli, abnormal_milli, greatest(0, 1000 - normal_milli - abnormal_milli)) AS max_milli
      FROM image_metrics_v) s""")
def score_decision(spark, sf):
    """Argmax of three class scores (first class wins ties); below the cut
    the case is inconclusive.  Scores are integers in thousandths."""
    m = V.image_metrics_v(spark, sf)
    n, a = F.col("normal_milli"), F.col("abnormal_milli")
    mx, dec = C.class_decision(n, a, F.greatest(F.lit(0), 1000 - n - a), _CUT_MILLI)
    return m.select("image_id", mx.alias("max_milli"), dec.alias("decision"))


@register("split_symptoms", """
SELECT case_id, 'symptoms' AS part, CAST(i AS INTEGER) AS pos, lst[i] AS item
FROM (SELECT case_id, CASE WHEN coalesce(symptoms, '') = '' THEN ['general'] ELSE string_split(symptoms, ', ') END AS lst
      FROM cases_v) s, range(1, len(lst) + 1) r(i)
UNION ALL
SELECT case_id, 'history' AS part, CAST(i AS INTEGER) AS pos, lst[i] AS item
FROM (SELECT case_id, CASE WHEN coalesce(history, '') = '' THEN []::VARCHAR[] ELSE string_split(history, ', ') END AS lst
      FROM cases_v) s, range(1, len(lst) + 1) r(i)""")
def split_symptoms(spark, sf):
    c = V.cases_v(spark, sf)
    parts = F.array(
        F.struct(F.lit("symptoms").alias("part"), C.split_list(F.col("symptoms"), ["general"]).alias("lst")),
        F.struct(F.lit("history").alias("part"), C.split_list(F.col("history"), None).alias("lst")),
    )
    return (c.select("case_id", F.explode(parts).alias("p"))
            .select("case_id", "p.part", F.posexplode("p.lst").alias("pos", "item"))
            .select("case_id", "part", (F.col("pos") + 1).cast("int").alias("pos"), "item"))


@register("slot_times", lambda: f"""
SELECT id, {T.sql_slot_start_text('date', 'time')} AS starts_at, {T.sql_slot_end('date', 'time')} AS ends_at FROM slots_v""")
def slot_times(spark, sf):
    s = V.slots_v(spark, sf)
    return s.select("id", T.slot_start_text(F.col("date"), F.col("time")).alias("starts_at"),
                    T.slot_end_text(F.col("date"), F.col("time")).alias("ends_at"))
