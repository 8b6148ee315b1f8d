"""Whole-case pipelines: the six-stage case report (K3-K5) and the chat
symptom analysis (H7).  Every stage is a column expression over the same
case row; the only joins are to small per-specialty lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.functions.rules import q
from wardlake.functions.text import sql_whitespace_tokens
from wardlake.operators import matching as M
from wardlake.operators import retrieval as RT
from wardlake.operators import scheduling as S
from wardlake.plans.matching_queries import _kg_ctes, _risk_ctes, risk_cases
from wardlake.plans.registry import register
from wardlake.session import write_table
from wardlake.sources import fixtures as V


def case_report_df(spark, sf):
    r = risk_cases(spark, sf)
    sev = C.severity_text(F.col("symptoms"), F.col("history"))
    r = r.withColumn("_crit", sev["critical"]).withColumn("_sev", sev["severity"])
    r = M.with_kg_scores(r, M.kg_text(F.col("symptoms"), F.col("history")))
    slots = (S.top_slots(V.slots_v(spark, sf), V.doctors_v(spark, sf), 3)
             .groupBy(F.col("specialty").alias("recommended_specialty"))
             .agg(F.count(F.lit(1)).cast("int").alias("n_doctors"), F.min("slot_id").alias("first_slot_id")))
    rule_risk = C.risk_score(F.col("symptoms"), F.col("age"))
    final = C.final_risk(F.col("combined_risk"), rule_risk)
    rep = r.select(
        "case_id", F.col("_sev").alias("severity"), F.col("_crit").alias("critical_symptoms"),
        F.col("combined_risk").alias("risk_score"), "risk_level",
        C.report_urgency(F.col("combined_risk")).alias("urgency"),
        C.report_recommendation(F.col("combined_risk")).alias("recommendation"),
        "recommended_specialty", "kg_specialty", "kg_risk_score",
        "posterior_risk", "ml_risk_pct", final.alias("final_risk"), C.risk_priority(final).alias("final_priority"),
    )
    # a row per specialty, written: cases join it by its measured size and are not dealt by a few specialties
    j = rep.join(write_table(slots, "first-slots"), "recommended_specialty", "left")
    return j.select("case_id", "severity", "critical_symptoms", "risk_score", "risk_level", "urgency", "recommendation",
                    "recommended_specialty", "kg_specialty", "kg_risk_score", "posterior_risk", "ml_risk_pct",
                    F.coalesce("n_doctors", F.lit(0)).alias("n_doctors"), "first_slot_id", "final_risk",
                    "final_priority")


def _case_report_sql():
    from wardlake.plans.scheduling_queries import _OPEN
    sev = C.sql_severity_lists("symptoms", "history")
    ctes = {**_risk_ctes(), **_kg_ctes()}
    ctes["open_s"] = _OPEN
    ctes["t3"] = """SELECT specialty, CAST(count(*) AS INTEGER) AS n_doctors, min(slot_id) AS first_slot_id FROM (
        SELECT *, row_number() OVER (PARTITION BY specialty ORDER BY slot_id) AS rn FROM open_s) x
        WHERE rn <= 3 GROUP BY specialty"""
    final = C.sql_final_risk("r.combined_risk", C.sql_risk_score("r.symptoms", "r.age"))
    return (f"""SELECT r.case_id, {sev['severity'].replace('symptoms', 'r.symptoms').replace('history', 'r.history')} AS severity,
        array_to_string({sev['critical'].replace('symptoms', 'r.symptoms').replace('history', 'r.history')}, ', ')
          AS critical_symptoms,
        r.combined_risk AS risk_score, {C.sql_risk_level('r.combined_risk')} AS risk_level,
        {C.sql_report_urgency('r.combined_risk')} AS urgency, {C.sql_report_recommendation('r.combined_risk')} AS recommendation,
        r.recommended_specialty, k.kg_specialty, k.kg_risk_score, r.posterior_risk, r.ml_risk_pct,
        coalesce(t.n_doctors, 0) AS n_doctors, t.first_slot_id, {final} AS final_risk,
        {C.sql_risk_priority(final)} AS final_priority
        FROM risk_case r JOIN kg_case k USING (case_id) LEFT JOIN t3 t ON t.specialty = r.recommended_specialty""", ctes)


@register("case_report", _case_report_sql)
def case_report(spark, sf):
    return case_report_df(spark, sf)


# --- the whole record of a case (K3, K5, H16) --------------------------------------------

def _offer_text(x):
    return F.format_string("%s: %s (%s), %s, %s %s", x["slot_id"].cast("string"), x["doctor_name"], x["specialty"], x["hospital"],
                           x["date"], x["time"])


def full_cases(spark, sf):
    """Every stage of the case pipeline side by side: severity, risk (model and Bayes), retrieval, graph, doctors.  A stage
    that finds nothing gives its default."""
    from wardlake.plans.retrieval_queries import case_guidelines
    r = risk_cases(spark, sf)
    sev = C.severity_text(F.col("symptoms"), F.col("history"))
    r = r.withColumns({"critical_symptoms": sev["critical"], "severity": sev["severity"],
                       "_s": F.lower("recommended_specialty"), "query": RT.case_query(F.col("symptoms"), F.col("history"))})
    r = M.with_kg_scores(r, M.kg_text(F.col("symptoms"), F.col("history")))
    offers = S.slots_by_specialty(V.slots_v(spark, sf), V.doctors_v(spark, sf)).withColumnRenamed("s", "_s")
    # written, so that cases join them by their measured size and are not dealt by a few specialties and texts
    return r.join(write_table(offers, "offers"), "_s", "left").join(case_guidelines(spark, sf), "query", "left").drop("_s", "query")


def _full_ctes() -> dict[str, str]:
    from wardlake.plans.retrieval_queries import guideline_ctes
    from wardlake.plans.scheduling_queries import _OPEN
    sev = C.sql_severity_lists("symptoms", "history")
    kg = {"kg_case": _kg_ctes()["kg_case"].replace("AS relationships", "AS kg_relationships")}
    return {
        **_risk_ctes(), **_kg_ctes(), **guideline_ctes(), "open_s": _OPEN, **kg,
        "offers": """SELECT lower(specialty) AS s, min(slot_id) AS slot_id, arg_min(doctor_name, slot_id) AS doctor_name,
            arg_min(specialty, slot_id) AS offered, arg_min(date, slot_id) AS date, arg_min(time, slot_id) AS time,
            string_agg(slot_id || ': ' || doctor_name || ' (' || specialty || '), ' || hospital || ', ' || date || ' ' || time, ' | '
              ORDER BY slot_id) AS available_doctors, count(*) AS n_offers
            FROM (SELECT *, row_number() OVER (PARTITION BY lower(specialty) ORDER BY slot_id) AS rn FROM open_s) x WHERE rn <= 3 GROUP BY 1""",
        "full_case": f"""SELECT r.*, {sev['severity']} AS severity, array_to_string({sev['critical']}, ', ') AS critical_symptoms,
            k.kg_specialty, k.kg_relationships, o.available_doctors, coalesce(o.n_offers, 0) > 0 AS doctor_found, o.slot_id, o.doctor_name,
            o.offered, o.date, o.time, coalesce(g.explanation, '{K.NO_GUIDELINE}') AS rag_explanation, g.context
            FROM risk_case r JOIN kg_case k USING (case_id) LEFT JOIN offers o ON o.s = lower(r.recommended_specialty)
            JOIN rq USING (case_id) LEFT JOIN guidelines g USING (query)""",
    }


_REPORT = ["case_id", "patient_id", "generated_at", "severity", "critical_symptoms", "risk_score", "risk_level", "urgency",
           "recommendation", "recommended_specialty", "ml_risk_prediction", "ml_risk_pct", "ml_confidence", "posterior_risk",
           "risk_percentage", "xai_priority", "xai_explanation", "rag_context", "rag_explanation", "kg_specialty",
           "kg_relationships", "available_doctors", "doctor_found", "disclaimer"]


@register("full_case_report", lambda: (f"""SELECT * RENAME (combined AS risk_score) FROM (SELECT case_id, patient_id,
    strftime(reported_at, '%Y-%m-%dT%H:%M:%S') AS generated_at, severity, critical_symptoms, combined_risk AS combined,
    {C.sql_risk_level('combined_risk')} AS risk_level, {C.sql_report_urgency('combined_risk')} AS urgency,
    {C.sql_report_recommendation('combined_risk')} AS recommendation, recommended_specialty, ml_risk_prediction, ml_risk_pct, ml_confidence,
    posterior_risk, risk_percentage, priority AS xai_priority, explanation AS xai_explanation, coalesce(context, '') AS rag_context,
    rag_explanation, kg_specialty, kg_relationships, coalesce(available_doctors, '') AS available_doctors, doctor_found,
    {q(K.DISCLAIMER)} AS disclaimer FROM full_case) x""", _full_ctes()))
def full_case_report(spark, sf):
    """The report of every case with all its parts: severity, risk by model and Bayes, rule explanation,
    retrieved guidelines, graph relationships and up to three open slots."""
    c = full_cases(spark, sf)
    return c.select(
        "case_id", "patient_id", F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), "severity",
        "critical_symptoms", F.col("combined_risk").alias("risk_score"), "risk_level",
        C.report_urgency(F.col("combined_risk")).alias("urgency"), C.report_recommendation(F.col("combined_risk")).alias("recommendation"),
        "recommended_specialty", "ml_risk_prediction", "ml_risk_pct", "ml_confidence", "posterior_risk", "risk_percentage",
        F.col("priority").alias("xai_priority"), F.col("explanation").alias("xai_explanation"),
        F.coalesce("context", F.lit("")).alias("rag_context"), F.coalesce("rag_explanation", F.lit(K.NO_GUIDELINE)).alias("rag_explanation"),
        "kg_specialty", F.col("relationships").alias("kg_relationships"),
        F.coalesce(F.array_join(F.transform("offers", _offer_text), " | "), F.lit("")).alias("available_doctors"),
        (F.coalesce(F.size("offers"), F.lit(0)) > 0).alias("doctor_found"), F.lit(K.DISCLAIMER).alias("disclaimer")).select(*_REPORT)


def _analysis_sql():
    from wardlake.plans.scheduling_queries import _FIRSTS
    items = C.sql_risk_attribution(C.sql_list_text("c.symptoms"), "c.age", "c.bp", "c.cholesterol")
    return (f"""SELECT c.case_id, c.hospital, c.symptoms, risk, {C.sql_risk_priority('risk')} AS priority, recommended_specialty AS specialty,
        coalesce(c.slot_id, f.slot_id) AS slot_id,
        CASE WHEN c.slot_id IS NOT NULL THEN c.doctor_name || ' (' || c.offered || ') at ' || c.time || ' (' || c.date || ')'
             WHEN f.slot_id IS NOT NULL THEN f.doctor_name || ' (General Physician - Fallback) at ' || f.time || ' (' || f.date || ')'
             ELSE 'No doctors available at this time.' END AS doctor,
        array_to_string(list_transform({items}, lambda x: x.name || ': ' || x.points), ', ') AS xai_details,
        coalesce(context, {_kb_sql('c.symptoms')}) AS rag_medical_context, kg_relationships, round(p0, 3) AS p_low, round(p1, 3) AS p_medium,
        round(p2, 3) AS p_high, {C.sql_report_urgency('combined_risk')} AS urgency, {C.sql_report_recommendation('combined_risk')} AS recommendation
        FROM (SELECT *, CAST(floor(least(combined_risk, 100)) AS INTEGER) AS risk
              FROM full_case) c JOIN boosted b ON b.id = c.case_id
        LEFT JOIN firsts f ON f.h = lower(c.hospital) AND f.s = 'general physician'""", {**_full_ctes(), "firsts": _FIRSTS})


@register("analyze_records", _analysis_sql)
def analyze_records(spark, sf):
    """K5: the stored analysis of every case: risk, priority, doctor and slot (else a General Physician of the
    hospital), attribution, retrieved snippets (else knowledge sentences), graph, class probabilities."""
    c = full_cases(spark, sf).withColumn("risk", F.floor(F.least("combined_risk", F.lit(100.0))).cast("int"))
    o = S.open_slots(V.slots_v(spark, sf), V.doctors_v(spark, sf)).filter(F.lower("specialty") == "general physician")
    spare = o.groupBy(F.lower("hospital").alias("_h")).agg(F.min(F.struct("slot_id", "doctor_name", "date", "time")).alias("_spare"))
    c = c.withColumns({"_h": F.lower("hospital"), "_first": F.try_element_at("offers", F.lit(1))}).join(
        write_table(spare, "spare-slots"), "_h", "left")
    told = lambda x, what: F.concat(x["doctor_name"], F.lit(" ("), what, F.lit(") at "), x["time"], F.lit(" ("), x["date"], F.lit(")"))
    first, other = F.col("_first"), F.col("_spare")
    items = C.risk_attribution(C.list_text(F.col("symptoms")), F.col("age"), F.col("bp"), F.col("cholesterol"))
    return c.select(
        "case_id", "hospital", "symptoms", "risk", C.risk_priority(F.col("risk")).alias("priority"),
        F.col("recommended_specialty").alias("specialty"), F.coalesce(first["slot_id"], other["slot_id"]).alias("slot_id"),
        F.when(first.isNotNull(), told(first, first["specialty"])).when(other.isNotNull(), told(other, F.lit("General Physician - Fallback")))
         .otherwise(F.lit("No doctors available at this time.")).alias("doctor"),
        F.array_join(F.transform(items, lambda x: F.concat(x["name"], F.lit(": "), x["points"].cast("string"))), ", ").alias("xai_details"),
        F.coalesce("context", RT.kb_overlap(F.col("symptoms"))).alias("rag_medical_context"), F.col("relationships").alias("kg_relationships"),
        *[F.round(F.element_at("ml_probabilities", i + 1), 3).alias(n) for i, n in enumerate(("p_low", "p_medium", "p_high"))],
        C.report_urgency(F.col("combined_risk")).alias("urgency"), C.report_recommendation(F.col("combined_risk")).alias("recommendation"))


def _kb_sql(text: str) -> str:
    toks = sql_whitespace_tokens(text)
    entries = []
    for i, s in enumerate(K.KB_SENTENCES):
        lst = "[" + ", ".join(q(t) for t in sorted(set(s.lower().split()))) + "]"
        entries.append(f"{{'neg': -len(list_intersect({toks}, {lst})), 'i': {i}, 's': {q(s)}}}")
    arr = f"list_filter([{', '.join(entries)}], lambda e: e.neg < 0)"
    return f"array_to_string(list_transform(list_slice(list_sort({arr}), 1, {K.OVERLAP_TOP_K}), lambda e: e.s), ' | ')"


@register("case_analysis", lambda: f"""SELECT case_id, risk_score, {C.sql_risk_priority('risk_score')} AS priority,
    recommended_specialty, {C.sql_risk_recommendation('risk_score')} AS recommendation, rag_medical_context,
    array_to_string(list_transform(xai, lambda x: x.name || ': ' || x.points), ', ') AS xai_details
    FROM (SELECT case_id, {C.sql_risk_score('symptoms')} AS risk_score,
                 {C.sql_choose_specialty('symptoms')} AS recommended_specialty, {C.sql_xai_items('symptoms')} AS xai,
                 {_kb_sql('symptoms')} AS rag_medical_context FROM cases_v) x""")
def case_analysis(spark, sf):
    """H7: chat analysis of the symptom message (default age), with its
    scored findings and the three best-overlapping knowledge sentences."""
    c = V.cases_v(spark, sf)
    score = C.risk_score(F.col("symptoms"))
    return c.select("case_id", score.alias("risk_score"), C.risk_priority(score).alias("priority"),
                    C.choose_specialty(F.col("symptoms")).alias("recommended_specialty"),
                    C.risk_recommendation(score).alias("recommendation"),
                    RT.kb_overlap(F.col("symptoms")).alias("rag_medical_context"),
                    F.array_join(F.transform(C.xai_items(F.col("symptoms")), lambda x: F.concat(
                        x["name"], F.lit(": "), x["points"].cast("string"))), ", ").alias("xai_details"))
