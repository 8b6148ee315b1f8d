"""Rule and knowledge-graph matching, scoring and Bayesian risk
(C5, C6, D15-D20, D17, H15, H17-H19, H31, G-4).

A case matches a rule when the rule keyword is a substring of the case text.
A rule list kept in code becomes one boolean column per rule.  All per-case answers are then plain CASE
arithmetic over those flags, inside whole-stage codegen:
- score, count and the Bayesian product are sums and products of CASE terms;
- the priority is a greatest() of ranks;
- the specialty is a greatest() over (score, first rule, name) structs, which
  gives the first-seen tie-break;
- explanation lists are concat_ws of CASE strings.
The job is map-only (no join, no shuffle), whatever the number of cases or
the skew of their content.

Rules given as a DataFrame, of any number, never reach the driver:
``match_rules_join`` gives the exact same matches with
an equi-join on q-grams, and ``rule_scores_join`` the same answers: every occurrence of a keyword starts with the
keyword's first q characters, so joining the text's q-grams against keyword
prefixes finds every candidate, and ``contains`` confirms it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.functions.rules import q as sql_q

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("specialty", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("risk_points", T.IntegerType(), False),
    T.StructField("multiplier", T.DoubleType(), False),
    T.StructField("explanation", T.StringType(), False),
])


def rules_frame(spark: SparkSession) -> DataFrame:
    """The seeded health-rule table as a DataFrame (A12 seed)."""
    return spark.createDataFrame(K.HEALTH_RULES, RULE_SCHEMA)


def rules_projection(rules: DataFrame) -> DataFrame:
    """Every rule without its id (the rule-listing tool)."""
    return rules.select(*[c for c in rules.columns if c != "id"])


def case_texts(symptoms: Column, history: Column) -> tuple[Column, Column]:
    """Texts the rule agent reads: the ', '-lists joined by spaces, lowered;
    blank symptoms count as 'general', blank history as ''."""
    s = F.coalesce(symptoms, F.lit(""))
    sym = F.when(s == "", F.lit("general")).otherwise(C.list_text(s))
    return sym, C.list_text(history)


def sql_case_texts(symptoms: str, history: str) -> tuple[str, str]:
    return (f"(CASE WHEN coalesce({symptoms}, '') = '' THEN 'general' ELSE {C.sql_list_text(symptoms)} END)",
            C.sql_list_text(history))


def _mult10(m: float) -> int:
    """Multipliers are stored in tenths so products are exact integers."""
    v = round(m * 10)
    if abs(v - m * 10) > 1e-9:
        raise ValueError(f"multiplier {m} has more than one decimal")
    return int(v)


def with_rule_flags(df: DataFrame, symptom_text: Column, history_text: Column,
                    rules=K.HEALTH_RULES) -> tuple[DataFrame, list[tuple[tuple, Column]]]:
    """Add one boolean column per rule (keyword found in the text its
    category reads).  The two texts are computed once; every flag is read by
    the score columns, so Catalyst keeps them as one projection."""
    rows = sorted(rules, key=lambda r: r[0])
    d = df.select("*", symptom_text.alias("_st"), history_text.alias("_ht"))
    d = d.select("*", *[(F.col("_st") if cat == "symptom" else F.col("_ht")).contains(kw.lower()).alias(f"_rule_{rid}")
                        for rid, kw, cat, *_ in rows])
    return d, [(r, F.col(f"_rule_{r[0]}")) for r in rows]


def matched_rule_array(flags: list[tuple[tuple, Column]]) -> Column:
    """array of matched-rule structs with NULLs for rules that did not match
    (explode it and drop the NULLs to get one row per match, in rule order)."""
    return F.array(*[F.when(f, F.struct(
        F.lit(rid).alias("rule_id"), F.lit(kw).alias("keyword"), F.lit(cat).alias("category"),
        F.lit(spec).alias("specialty"), F.lit(prio).alias("priority"), F.lit(pts).alias("points"),
        F.lit(mult).alias("multiplier"), F.lit(expl).alias("explanation")))
        for (rid, kw, cat, spec, prio, pts, mult, expl), f in flags])


def _sum(terms: list[Column]) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + t
    return total


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def _argmax(groups: dict[str, list[tuple[Column, int, int]]]) -> Column:
    """groups: name -> [(flag, order, weight)] in order.  The name with the
    highest summed weight of its matched items; ties go to the name whose
    first matched item comes first (insertion order of a running dict)."""
    cands = []
    for name, items in groups.items():
        score = _sum([F.when(f, F.lit(w)).otherwise(F.lit(0)) for f, _, w in items])
        first = None
        for f, o, _ in items:
            first = F.when(f, F.lit(-o)) if first is None else first.when(f, F.lit(-o))
        cands.append(F.when(_any([f for f, _, _ in items]),
                            F.struct(score.alias("s"), first.alias("f"), F.lit(name).alias("n"))))
    best = cands[0] if len(cands) == 1 else F.greatest(*cands)
    return best["n"]


def rule_score_columns(flags: list[tuple[tuple, Column]]) -> dict[str, Column]:
    """Per-case answers from the rule flags (D15, D16, D18-D20, H19, D17):
    sums and products of CASE terms and a greatest() over specialties."""
    fl = [f for _, f in flags]
    has = _any(fl)
    n = _sum([F.when(f, F.lit(1)).otherwise(F.lit(0)) for f in fl])
    score = _sum([F.when(f, F.lit(r[5])).otherwise(F.lit(0)) for r, f in flags])
    groups: dict[str, list] = {}
    for r, f in flags:
        groups.setdefault(r[3], []).append((f, r[0], r[5]))
    prank = F.greatest(*[F.when(f, F.lit(K.PRIORITY_RANK[r[4]])) for r, f in flags], F.lit(None).cast("int"))
    prio = None
    for name, rank in K.PRIORITY_RANK.items():
        prio = F.when(prank == rank, F.lit(name)) if prio is None else prio.when(prank == rank, F.lit(name))
    prod10 = F.lit(1.0)  # tenths: exact below 2^53, no overflow above, any multiplier
    for r, f in flags:
        prod10 = prod10 * F.when(f, F.lit(round(r[6] * 10.0, 9))).otherwise(F.lit(1.0))
    return _answers(has, n, score, _argmax(groups), prio, prod10,
                    F.concat_ws(" | ", *[F.when(f, F.lit(r[7])) for r, f in flags]))


def _answers(has: Column, n: Column, score: Column, specialty: Column, priority: Column, prod10: Column,
             explanation: Column) -> dict[str, Column]:
    posterior = F.least(prod10 / F.pow(F.lit(10.0), n + 1), F.lit(K.BAYES_CAP))
    pct = F.least(prod10 / F.pow(F.lit(10.0), n - 1), F.lit(K.BAYES_CAP * 100))
    return {
        "n_rules": n,
        "recommended_specialty": F.when(has, specialty).otherwise(F.lit(K.NO_RULE_DEFAULT[0])),
        "priority": F.when(has, priority).otherwise(F.lit(K.NO_RULE_DEFAULT[1])),
        "risk_score": F.when(has, score).otherwise(F.lit(K.NO_RULE_DEFAULT[2])),
        "confidence": F.when(has, F.least(score / 100.0, F.lit(K.RULE_CONFIDENCE_CAP)))
                       .otherwise(F.lit(K.NO_RULE_DEFAULT[3])),
        "explanation": F.when(has, explanation).otherwise(F.lit(K.NO_RULE_EXPLANATION)),
        # Bayesian-style update: prior 0.10 times every matched multiplier, capped.
        "posterior_risk": F.round(F.when(has, posterior).otherwise(F.lit(K.BAYES_PRIOR)), 2),
        "risk_percentage": F.round(F.when(has, pct).otherwise(F.lit(K.BAYES_PRIOR * 100)), 2),
    }


def rule_scores_join(cases: DataFrame, key: str, symptom_text: Column, history_text: Column,
                     rules: DataFrame) -> DataFrame:
    """``cases`` plus the rule answers, for a rule table of any size: the matches of
    ``match_rules_join`` summed per (case, specialty) and then per case."""
    ranks = F.create_map(*[F.lit(x) for pair in K.PRIORITY_RANK.items() for x in pair])
    names = F.create_map(*[F.lit(x) for name, rank in K.PRIORITY_RANK.items() for x in (rank, name)])
    per_specialty = match_rules_join(cases, key, symptom_text, history_text, rules).groupBy(key, "specialty").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points").alias("s"), F.min("rule_id").alias("f"),
        F.max(ranks[F.col("priority")]).alias("r"), F.product(F.round(F.col("multiplier") * 10.0, 9)).alias("p"),
        F.collect_list(F.struct("rule_id", "explanation")).alias("e"))
    per_case = per_specialty.groupBy(key).agg(
        F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.max("r").alias("_r"), F.product("p").alias("_p"),
        F.max(F.struct("s", (-F.col("f")).alias("f"), "specialty"))["specialty"].alias("_spec"),
        F.array_sort(F.flatten(F.collect_list("e"))).alias("_e"))
    j = cases.join(per_case, key, "left")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("int")
    answers = _answers(F.col("_n").isNotNull(), n, F.col("_s").cast("int"), F.col("_spec"), names[F.col("_r")], F.col("_p"),
                       F.array_join(F.transform("_e", lambda x: x["explanation"]), " | "))
    return j.select(*cases.columns, *[v.alias(k) for k, v in answers.items()])


def with_rule_scores(df: DataFrame, symptom_text: Column, history_text: Column, rules=K.HEALTH_RULES,
                     keep_flags: bool = False) -> DataFrame:
    """``df`` plus the rule answers (n_rules, recommended_specialty, priority,
    risk_score, confidence, explanation, posterior_risk, risk_percentage)."""
    d, flags = with_rule_flags(df, symptom_text, history_text, rules)
    d = d.select("*", *[v.alias(k) for k, v in rule_score_columns(flags).items()])
    if keep_flags:
        return d
    return d.drop("_st", "_ht", *[f"_rule_{r[0]}" for r, _ in flags])


def rule_match_rows(df: DataFrame, key: str, symptom_text: Column, history_text: Column,
                    rules=K.HEALTH_RULES) -> DataFrame:
    """One row per (case, matched rule), in rule order."""
    d, flags = with_rule_flags(df.select(key, "symptoms", "history"), symptom_text, history_text, rules)
    return (d.select(key, F.explode(matched_rule_array(flags)).alias("r"))
            .filter(F.col("r").isNotNull()).select(key, "r.*"))


def match_rules_join(cases: DataFrame, key: str, symptom_text: Column, history_text: Column,
                     rules: DataFrame) -> DataFrame:
    """Exact substring matches for a rule table of any size, as an equi-join.

    Returns (key, rule_id, keyword, category, specialty, priority, points,
    multiplier, explanation), one row per (case, matched rule).
    """
    qlen = rules.agg(F.min(F.length("keyword"))).first()[0] or 1
    texts = cases.select(
        F.col(key), F.explode(F.array(
            F.struct(F.lit("symptom").alias("src"), symptom_text.alias("text")),
            F.struct(F.lit("history").alias("src"), history_text.alias("text")))).alias("t"),
    ).select(key, "t.src", "t.text")
    grams = texts.select(
        key, "src", "text",
        F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - qlen + 1, F.lit(0)))).alias("i"),
    ).select(key, "src", "text", F.substring("text", F.col("i"), qlen).alias("gram")).distinct()
    r = rules.select(
        F.col("id").alias("rule_id"), "keyword", "category", "specialty", "priority", "risk_points", "multiplier",
        "explanation", F.substring(F.lower("keyword"), 1, qlen).alias("gram"),
        F.when(F.col("category") == "symptom", "symptom").otherwise("history").alias("src"),
    )
    cand = grams.join(r, ["src", "gram"])
    return (cand.filter(F.col("text").contains(F.lower(F.col("keyword"))))
            .select(key, "rule_id", "keyword", "category", "specialty", "priority",
                    F.col("risk_points").alias("points"), "multiplier", "explanation")
            .distinct())


# --- knowledge graph --------------------------------------------------------------

def kg_edge_rows() -> list[tuple]:
    """(edge_ord, symptom, specialty, weight, risk) in traversal order:
    symptom nodes in node order, each node's out-edges in insertion order."""
    out, ord_ = [], 0
    for node in K.KG_SYMPTOMS:
        for s, sp, w, risk in K.KG_EDGES:
            if s == node:
                ord_ += 1
                out.append((ord_, s, sp, w, risk))
    return out


def kg_edges_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(kg_edge_rows(), "edge_ord int, symptom string, specialty string, weight int, risk string")


def kg_nodes_frame(spark: SparkSession) -> DataFrame:
    """Graph node list (G-4): every symptom and specialty with its type."""
    edges = kg_edges_frame(spark)
    return (edges.select(F.col("symptom").alias("id"), F.lit("symptom").alias("type"))
            .unionByName(edges.select(F.col("specialty").alias("id"), F.lit("specialty").alias("type")))
            .distinct())


def kg_text(symptoms: Column, history: Column) -> Column:
    return F.lower(F.concat(F.coalesce(symptoms, F.lit("")), F.lit(" "), F.coalesce(history, F.lit(""))))


def sql_kg_text(symptoms: str, history: str) -> str:
    return f"lower(coalesce({symptoms}, '') || ' ' || coalesce({history}, ''))"


def with_kg_flags(df: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """One boolean column per symptom node found in the (lowered) text."""
    nodes = list(dict.fromkeys(s for _, s, _, _, _ in kg_edge_rows()))
    d = df.select("*", text.alias("_kt"))
    d = d.select("*", *[F.col("_kt").contains(n).alias(f"_kg_{i}") for i, n in enumerate(nodes)])
    return d, {n: F.col(f"_kg_{i}") for i, n in enumerate(nodes)}


def kg_match_array(node_flags: dict[str, Column]) -> Column:
    """array of out-edge structs of every matched node (NULL otherwise), in
    traversal order."""
    return F.array(*[F.when(node_flags[s], F.struct(
        F.lit(o).alias("edge_ord"), F.lit(s).alias("symptom"), F.lit(sp).alias("specialty"),
        F.lit(w).alias("weight"), F.lit(r).alias("risk"),
        F.lit(f"{s.title()} → {sp} (+{w})").alias("relationship"))) for o, s, sp, w, r in kg_edge_rows()])


def kg_score_columns(node_flags: dict[str, Column]) -> dict[str, Column]:
    edges = kg_edge_rows()
    has = _any(list(node_flags.values()))
    groups: dict[str, list] = {}
    for o, s, sp, w, _ in edges:
        groups.setdefault(sp, []).append((node_flags[s], o, w))
    total = _sum([F.when(node_flags[s], F.lit(w)).otherwise(F.lit(0)) for _, s, _, w, _ in edges])
    rel = F.concat_ws(" | ", *[F.when(node_flags[s], F.lit(f"{s.title()} → {sp} (+{w})")) for _, s, sp, w, _ in edges])
    return {
        "kg_specialty": F.when(has, _argmax(groups)).otherwise(F.lit(K.KG_DEFAULT[0])),
        "kg_risk_score": F.when(has, total).otherwise(F.lit(K.KG_DEFAULT[1])),
        "relationships": F.when(has, rel).otherwise(F.lit(K.KG_NO_MATCH)),
    }


def with_kg_scores(df: DataFrame, text: Column) -> DataFrame:
    d, flags = with_kg_flags(df, text)
    d = d.select("*", *[v.alias(k) for k, v in kg_score_columns(flags).items()])
    return d.drop("_kt", *[c for c in d.columns if c.startswith("_kg_")])


def kg_match_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
    """One row per (case, out-edge of a matched symptom node)."""
    d, flags = with_kg_flags(df, text)
    return (d.select(key, F.explode(kg_match_array(flags)).alias("e"))
            .filter(F.col("e").isNotNull()).select(key, "e.*"))


# --- SQL twins -----------------------------------------------------------------------

def sql_rules_values(rules: Sequence[tuple] = K.HEALTH_RULES) -> str:
    rows = ", ".join(
        f"({rid}, {sql_q(kw)}, {sql_q(cat)}, {sql_q(sp)}, {sql_q(pr)}, {K.PRIORITY_RANK[pr]}, {pts}, {_mult10(m)}, "
        f"{sql_q(ex)})" for rid, kw, cat, sp, pr, pts, m, ex in rules)
    return (f"(SELECT * FROM (VALUES {rows}) v(rule_id, keyword, category, specialty, priority, prank, points, "
            f"mult10, explanation))")


def sql_kg_values() -> str:
    rows = ", ".join(f"({o}, {sql_q(s)}, {sql_q(sp)}, {w}, {sql_q(r)}, {sql_q(f'{s.title()} → {sp} (+{w})')})"
                     for o, s, sp, w, r in kg_edge_rows())
    return f"(SELECT * FROM (VALUES {rows}) v(edge_ord, symptom, specialty, weight, risk, relationship))"
