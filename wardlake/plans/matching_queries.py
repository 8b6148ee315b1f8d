"""Rule/graph matching, Bayesian and combined risk queries (C5, C6, D15-D20,
H15-H19, H28, H36).  All map-only over ``cases_v``; the oracle uses a real
theta join + GROUP BY, so it checks the array formulation independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.functions import timefn as T
from wardlake.operators import matching as M
from wardlake.plans import ml_queries as MQ
from wardlake.plans.registry import register
from wardlake.sources import fixtures as V
from wardlake.sources.tables import spread


def scored_cases(spark, sf) -> DataFrame:
    """cases_v + rule-match array + per-case rule scores + Bayesian risk."""
    c = V.cases_v(spark, sf)
    st, ht = M.case_texts(F.col("symptoms"), F.col("history"))
    return M.with_rule_scores(c, st, ht)


def _rule_ctes() -> dict[str, str]:
    st, ht = M.sql_case_texts("symptoms", "history")
    return {
        "rules_t": M.sql_rules_values(),
        "case_txt": f"SELECT *, {st} AS st, {ht} AS ht FROM cases_v",
        "rule_hits": """SELECT c.case_id, r.* FROM case_txt c JOIN rules_t r
            ON CASE WHEN r.category = 'symptom' THEN contains(c.st, lower(r.keyword)) ELSE contains(c.ht, lower(r.keyword)) END""",
        "rule_agg": """SELECT case_id, count(*) AS n, sum(points) AS score, product(mult10) AS prod, max(prank) AS prank,
            arg_max(priority, prank) AS prio, string_agg(explanation, ' | ' ORDER BY rule_id) AS expl
            FROM rule_hits GROUP BY case_id""",
        "rule_spec": """SELECT case_id, specialty FROM (
            SELECT case_id, specialty, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, f ASC) AS rn
            FROM (SELECT case_id, specialty, sum(points) AS s, min(rule_id) AS f FROM rule_hits GROUP BY 1, 2) x) y
            WHERE rn = 1""",
        "rule_case": f"""SELECT c.*, CAST(coalesce(a.n, 0) AS INTEGER) AS n_rules,
            coalesce(b.specialty, '{K.NO_RULE_DEFAULT[0]}') AS recommended_specialty,
            coalesce(a.prio, '{K.NO_RULE_DEFAULT[1]}') AS priority,
            CAST(coalesce(a.score, {K.NO_RULE_DEFAULT[2]}) AS INTEGER) AS risk_score,
            CASE WHEN a.n IS NULL THEN {K.NO_RULE_DEFAULT[3]} ELSE least(CAST(a.score AS DOUBLE) / 100, {K.RULE_CONFIDENCE_CAP}) END AS confidence,
            coalesce(a.expl, '{K.NO_RULE_EXPLANATION}') AS explanation,
            round(CASE WHEN a.n IS NULL THEN {K.BAYES_PRIOR} ELSE least(CAST(a.prod AS DOUBLE) / power(10.0, a.n + 1), {K.BAYES_CAP}) END, 2) AS posterior_risk,
            round(CASE WHEN a.n IS NULL THEN {K.BAYES_PRIOR * 100} ELSE least(CAST(a.prod AS DOUBLE) / power(10.0, a.n - 1), {K.BAYES_CAP * 100}) END, 2) AS risk_percentage
            FROM cases_v c LEFT JOIN rule_agg a USING (case_id) LEFT JOIN rule_spec b USING (case_id)""",
    }


@register("rule_matches", lambda: ("SELECT case_id, rule_id, keyword, specialty, points FROM rule_hits", _rule_ctes()))
def rule_matches(spark, sf):
    c = V.cases_v(spark, sf)
    st, ht = M.case_texts(F.col("symptoms"), F.col("history"))
    return M.rule_match_rows(c, "case_id", st, ht).select("case_id", "rule_id", "keyword", "specialty", "points")


@register("rule_scores", lambda: ("""SELECT case_id, n_rules, recommended_specialty, priority, risk_score, confidence
    FROM rule_case""", _rule_ctes()))
def rule_scores(spark, sf):
    return scored_cases(spark, sf).select("case_id", "n_rules", "recommended_specialty", "priority", "risk_score",
                                          "confidence")


@register("rule_explanations", lambda: ("SELECT case_id, n_rules, explanation FROM rule_case", _rule_ctes()))
def rule_explanations(spark, sf):
    return scored_cases(spark, sf).select("case_id", "n_rules", "explanation")


@register("bayes_risk", lambda: ("SELECT case_id, n_rules, posterior_risk, risk_percentage FROM rule_case", _rule_ctes()))
def bayes_risk(spark, sf):
    return scored_cases(spark, sf).select("case_id", "n_rules", "posterior_risk", "risk_percentage")


# --- knowledge graph ---------------------------------------------------------------

def kg_cases(spark, sf) -> DataFrame:
    c = V.cases_v(spark, sf)
    return M.with_kg_scores(c, M.kg_text(F.col("symptoms"), F.col("history")))


def _kg_ctes() -> dict[str, str]:
    return {
        "kg_t": M.sql_kg_values(),
        "kg_hits": f"""SELECT c.case_id, e.* FROM cases_v c JOIN kg_t e
            ON contains({M.sql_kg_text('c.symptoms', 'c.history')}, e.symptom)""",
        "kg_spec": """SELECT case_id, specialty FROM (
            SELECT case_id, specialty, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, f ASC) AS rn
            FROM (SELECT case_id, specialty, sum(weight) AS s, min(edge_ord) AS f FROM kg_hits GROUP BY 1, 2) x) y
            WHERE rn = 1""",
        "kg_agg": """SELECT case_id, sum(weight) AS total, string_agg(relationship, ' | ' ORDER BY edge_ord) AS rel
            FROM kg_hits GROUP BY case_id""",
        "kg_case": f"""SELECT c.case_id, coalesce(s.specialty, '{K.KG_DEFAULT[0]}') AS kg_specialty,
            CAST(coalesce(a.total, {K.KG_DEFAULT[1]}) AS INTEGER) AS kg_risk_score,
            coalesce(a.rel, '{K.KG_NO_MATCH}') AS relationships
            FROM cases_v c LEFT JOIN kg_agg a USING (case_id) LEFT JOIN kg_spec s USING (case_id)""",
    }


@register("kg_matches", lambda: ("SELECT case_id, edge_ord, symptom, specialty, weight, risk FROM kg_hits", _kg_ctes()))
def kg_matches(spark, sf):
    c = V.cases_v(spark, sf)
    return (M.kg_match_rows(c, "case_id", M.kg_text(F.col("symptoms"), F.col("history")))
            .select("case_id", "edge_ord", "symptom", "specialty", "weight", "risk"))


@register("kg_specialty_scores", lambda: ("SELECT case_id, specialty, CAST(sum(weight) AS BIGINT) AS score FROM kg_hits GROUP BY 1, 2",
                                          _kg_ctes()))
def kg_specialty_scores(spark, sf):
    """Summed edge weight of every (case, specialty) that a matched symptom leads to."""
    c = V.cases_v(spark, sf)
    hits = M.kg_match_rows(c, "case_id", M.kg_text(F.col("symptoms"), F.col("history")))
    return hits.groupBy("case_id", "specialty").agg(F.sum("weight").alias("score"))


@register("kg_scores", lambda: ("SELECT case_id, kg_specialty, kg_risk_score FROM kg_case", _kg_ctes()))
def kg_scores(spark, sf):
    return kg_cases(spark, sf).select("case_id", "kg_specialty", "kg_risk_score")


@register("kg_relationships", lambda: ("SELECT case_id, relationships FROM kg_case", _kg_ctes()))
def kg_relationships(spark, sf):
    return kg_cases(spark, sf).select("case_id", "relationships")


# --- combined risk stages ---------------------------------------------------------------

def risk_stage(c: DataFrame, model=None) -> DataFrame:
    """The risk stage per case: the model's risk percentage and confidence where there is a
    model and the case has its features, else the keyword score and a fixed confidence; Bayesian risk,
    combined risk and level, appointment urgency, uncertainty.  ``c``: cases with rule scores."""
    c = MQ.with_ml_risk(c, model)
    c = c.withColumns({
        "ml_risk_pct": F.coalesce("ml_risk_pct", C.fallback_risk_pct(F.col("symptoms")).cast("double")),
        "ml_confidence": F.coalesce("ml_confidence", F.lit(K.FALLBACK_ML_CONFIDENCE)),
        "ml_risk_prediction": F.coalesce("ml_risk_prediction", C.risk_level(C.fallback_risk_pct(F.col("symptoms"))))})
    combined = F.round(F.greatest(F.col("ml_risk_pct"), F.col("risk_percentage")), 1)
    avg = (F.col("risk_percentage") + F.col("ml_risk_pct")) / 2
    conf = (F.col("confidence") + (1 - F.col("posterior_risk")) + F.col("ml_confidence")) / 3
    return c.select(
        "*", combined.alias("combined_risk"), C.risk_level(combined).alias("risk_level"),
        avg.alias("avg_risk"), C.appointment_urgency(avg).alias("appointment_urgency"),
        C.schedule_type(avg).alias("schedule_type"), conf.alias("combined_confidence"),
    )


def risk_cases(spark, sf) -> DataFrame:
    """The risk stage over all cases, with the boosted risk model."""
    c = spread(V.cases_v(spark, sf), least=5_000)
    return risk_stage(M.with_rule_scores(c, *M.case_texts(F.col("symptoms"), F.col("history"))), MQ.risk_booster(spark, sf))


def _risk_ctes() -> dict[str, str]:
    ctes = _rule_ctes() | MQ.ml_risk_ctes()
    ctes["risk_case"] = f"""SELECT *, round(greatest(ml_risk_pct, risk_percentage), 1) AS combined_risk,
        (risk_percentage + ml_risk_pct) / 2 AS avg_risk,
        (confidence + (1 - posterior_risk) + ml_confidence) / 3 AS combined_confidence
        FROM (SELECT r.* , coalesce(m.ml_risk_pct, {C.sql_fallback_risk_pct('r.symptoms')}) AS ml_risk_pct,
                coalesce(m.ml_confidence, {K.FALLBACK_ML_CONFIDENCE}) AS ml_confidence,
                coalesce(m.ml_risk_prediction, {C.sql_risk_level(C.sql_fallback_risk_pct('r.symptoms'))}) AS ml_risk_prediction
              FROM rule_case r LEFT JOIN ml_risk m USING (case_id)) x"""
    return ctes


@register("combined_risk", lambda: (f"""SELECT case_id, ml_risk_pct, risk_percentage, combined_risk,
    {C.sql_risk_level('combined_risk')} AS risk_level FROM risk_case""", _risk_ctes()))
def combined_risk(spark, sf):
    return risk_cases(spark, sf).select("case_id", "ml_risk_pct", "risk_percentage", "combined_risk", "risk_level")


@register("urgency_bands", lambda: (f"""SELECT case_id, avg_risk, {C.sql_appointment_urgency('avg_risk')} AS urgency,
    {C.sql_schedule_type('avg_risk')} AS schedule_type FROM risk_case""", _risk_ctes()))
def urgency_bands(spark, sf):
    return risk_cases(spark, sf).select("case_id", "avg_risk", F.col("appointment_urgency").alias("urgency"),
                                        "schedule_type")


@register("uncertainty", lambda: (f"""SELECT case_id, confidence AS xai_confidence,
    1 - posterior_risk AS bayesian_confidence, ml_confidence, combined_confidence,
    {C.sql_uncertainty_level('combined_confidence')} AS uncertainty_level,
    {C.sql_treatment_recommendation('combined_confidence')} AS treatment_recommendation FROM risk_case""", _risk_ctes()))
def uncertainty(spark, sf):
    r = risk_cases(spark, sf)
    cc = F.col("combined_confidence")
    return r.select("case_id", F.col("confidence").alias("xai_confidence"),
                    (1 - F.col("posterior_risk")).alias("bayesian_confidence"),
                    "ml_confidence", "combined_confidence",
                    C.uncertainty_level(cc).alias("uncertainty_level"),
                    C.treatment_recommendation(cc).alias("treatment_recommendation"))


@register("schedule_offsets", lambda: (f"""SELECT case_id, schedule_type,
    strftime({T.sql_schedule_at('reported_at', 'schedule_type')}, '%Y-%m-%d %H:%M:%S') AS appointment_at
    FROM (SELECT *, {C.sql_schedule_type('avg_risk')} AS schedule_type FROM risk_case) x""", _risk_ctes()))
def schedule_offsets(spark, sf):
    """Appointment time per case from its urgency, counted from the time the
    case was reported (never from the wall clock)."""
    r = risk_cases(spark, sf)
    at = T.schedule_at(F.col("reported_at"), F.col("schedule_type"))
    return r.select("case_id", "schedule_type", F.date_format(at, T.OUT).alias("appointment_at"))


@register("final_priority", lambda: (f"""SELECT case_id, combined_risk AS crew_risk, rule_risk, final_risk,
    {C.sql_risk_priority('final_risk')} AS priority
    FROM (SELECT *, {C.sql_risk_score('symptoms', 'age')} AS rule_risk,
                 {C.sql_final_risk('combined_risk', C.sql_risk_score('symptoms', 'age'))} AS final_risk
          FROM risk_case) x""", _risk_ctes()))
def final_priority(spark, sf):
    r = risk_cases(spark, sf)
    rule_risk = C.risk_score(F.col("symptoms"), F.col("age"))
    final = C.final_risk(F.col("combined_risk"), rule_risk)
    return r.select("case_id", F.col("combined_risk").alias("crew_risk"), rule_risk.alias("rule_risk"),
                    final.alias("final_risk"), C.risk_priority(final).alias("priority"))
