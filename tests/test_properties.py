"""Property test: the column expressions equal a plain-Python model of the
per-request rules on random symptom/history lists (hypothesis)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.operators import matching as M

VOCAB = sorted({kw for _, kw, *_ in K.HEALTH_RULES} | set(K.KG_SYMPTOMS) | {"pain", "bp", "subpar", "cold", "general"}
               | {p for ps, _ in K.DISEASE_RULES for p in ps})
phrase_lists = st.lists(st.sampled_from(VOCAB), min_size=0, max_size=4)
cases = st.lists(st.tuples(phrase_lists, phrase_lists, st.integers(18, 90)), min_size=1, max_size=25)


def best_total(pairs, default):
    """The name with the greatest total; of equal ones that met first."""
    names = [name for name, _ in pairs]
    totals = {n: sum(v for name, v in pairs if name == n) for n in names}
    return min(totals, key=lambda n: (-totals[n], names.index(n))) if totals else default


def py_rule_agent(symptoms, history):
    texts = {"symptom": " ".join(symptoms or ["general"]).lower()}
    met = [r for r in K.HEALTH_RULES if r[1] in texts.get(r[2], " ".join(history).lower())]
    if not met:
        return "General Physician", "Normal", 10, 0.10
    return (best_total([(r[3], r[5]) for r in met], None), max((r[4] for r in met), key=K.PRIORITY_RANK.get),
            sum(r[5] for r in met), round(min(0.10 * math.prod(r[6] for r in met), 0.95), 2))


def py_kg(text):
    met = [(e[1], e[2]) for node in K.KG_SYMPTOMS if node in text for e in K.KG_EDGES if e[0] == node]
    return best_total(met, "General Physician"), sum(w for _, w in met) if met else 10


def py_risk(text, age):
    t = text.lower()
    r = sum(p for ps, p in K.RISK_POINTS if any(x in t for x in ps)) + (10 if age >= 60 else 0)
    return min(r, 100)


def py_first(text, rules, default):
    t = text.lower()
    return next((v for ps, v in rules if any(x in t for x in ps)), default)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cases)
def test_rule_columns_equal_python_model(spark, data):
    rows = [(i, ", ".join(s), ", ".join(h), a) for i, (s, h, a) in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, symptoms string, history string, age int")
    st_, ht_ = M.case_texts(F.col("symptoms"), F.col("history"))
    out = M.with_rule_scores(df, st_, ht_)
    out = M.with_kg_scores(out, M.kg_text(F.col("symptoms"), F.col("history")))
    spec = C.choose_specialty(F.col("symptoms"))
    got = {r.id: r for r in out.select(
        "id", "recommended_specialty", "priority", "risk_score", "posterior_risk", "kg_specialty", "kg_risk_score",
        C.risk_score(F.col("symptoms"), F.col("age")).alias("rs"), spec.alias("spec"),
        C.infer_disease(F.col("symptoms"), spec).alias("disease")).collect()}
    for i, sym, hist, age in rows:
        r = got[i]
        s_list = sym.split(", ") if sym else []
        h_list = hist.split(", ") if hist else []
        assert (r.recommended_specialty, r.priority, r.risk_score) == py_rule_agent(s_list, h_list)[:3]
        assert r.posterior_risk == py_rule_agent(s_list, h_list)[3]
        assert (r.kg_specialty, r.kg_risk_score) == py_kg((sym + " " + hist).lower())
        assert r.rs == py_risk(sym, age)
        want_spec = py_first(sym, K.SPECIALTY_RULES, K.SPECIALTY_DEFAULT)
        assert r.spec == want_spec
        assert r.disease == py_first(sym, K.DISEASE_RULES, want_spec or K.DISEASE_DEFAULT)
