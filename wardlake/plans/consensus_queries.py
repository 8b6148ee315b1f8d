"""Multi-model consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.functions.rules import q
from wardlake.functions.text import WHITESPACE
from wardlake.operators import consensus as CS
from wardlake.plans.registry import register
from wardlake.sources import fixtures as V

_RANK_SQL = "CASE {c} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in K.URGENCY_RANK.items()) + " ELSE 0 END"


def _vote_ctes(source: str) -> dict[str, str]:
    return {
        "v": f"""SELECT * REPLACE (coalesce(urgency, '{K.MISSING_VOTE[0]}') AS urgency,
                                   coalesce(specialty, '{K.MISSING_VOTE[1]}') AS specialty) FROM {source}""",
        "uv": "SELECT case_id, urgency, count(*) AS n FROM v GROUP BY 1, 2",
        "cu": f"""SELECT case_id, urgency AS consensus_urgency FROM (
            SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, {_RANK_SQL.format(c='urgency')} DESC) AS rn
            FROM uv) x WHERE rn = 1""",
        "sv": "SELECT case_id, specialty, count(*) AS n FROM v GROUP BY 1, 2",
        "sw": """SELECT case_id, count(*) AS n_win, min(specialty) AS only_spec FROM (
            SELECT *, max(n) OVER (PARTITION BY case_id) AS mx FROM sv) x WHERE n = mx GROUP BY case_id""",
        "cand": """SELECT case_id, specialty FROM (
            SELECT c.case_id, c.specialty, row_number() OVER (PARTITION BY c.case_id ORDER BY s.n DESC, c.fo ASC) AS rn
            FROM (SELECT v.case_id, v.specialty, min(v.model_ord) AS fo FROM v
                  JOIN cu ON v.case_id = cu.case_id AND v.urgency = cu.consensus_urgency GROUP BY 1, 2) c
            JOIN sv s ON s.case_id = c.case_id AND s.specialty = c.specialty) x WHERE rn = 1""",
        "dec": """SELECT cu.case_id, cu.consensus_urgency,
            CASE WHEN sw.n_win = 1 THEN sw.only_spec ELSE cand.specialty END AS consensus_specialty
            FROM cu JOIN sw USING (case_id) LEFT JOIN cand USING (case_id)""",
        "mv": """SELECT *, bool_or(both_) OVER (PARTITION BY case_id) AS any_both FROM (
            SELECT v.*, d.consensus_urgency, d.consensus_specialty,
                   (v.urgency = d.consensus_urgency AND v.specialty = d.consensus_specialty) AS both_,
                   v.urgency = d.consensus_urgency AS on_u
            FROM v JOIN dec d USING (case_id)) x""",
    }


@register("vote_consensus", lambda: ("SELECT case_id, consensus_urgency, consensus_specialty FROM dec",
                                     _vote_ctes("votes_v")))
def vote_consensus(spark, sf):
    return CS.consensus(V.votes_v(spark, sf))


@register("vote_tallies", lambda: ("""SELECT case_id, 'urgency' AS field, urgency AS value, n AS votes FROM uv
    UNION ALL SELECT case_id, 'specialty', specialty, n FROM sv""", _vote_ctes("votes_v")))
def vote_tallies(spark, sf):
    return CS.tallies(V.votes_v(spark, sf))


@register("vote_members", lambda: ("""SELECT case_id,
    string_agg(CASE WHEN (any_both AND both_) OR (NOT any_both AND on_u) THEN upper(model) END, ', ' ORDER BY model_ord)
      AS consensus_models,
    CAST(count(*) FILTER (WHERE mode = 'live') AS INTEGER) AS live_models_count,
    count(*) FILTER (WHERE mode = 'live') > 0 AS live_mode
    FROM mv GROUP BY case_id""", _vote_ctes("votes_v")))
def vote_members(spark, sf):
    return CS.members(V.votes_v(spark, sf)).select("case_id", "consensus_models", "live_models_count", "live_mode")


# --- reply parsing -----------------------------------------------------------------

def _s(x: str) -> str:
    return C.sql_pystrip(x)


def _title(v: str) -> str:
    """Character by character: a letter after a letter is small, any other a capital."""
    return (f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({v}, CAST(i - 1 AS INTEGER), 1), "
            f"'\\p{{L}}') THEN lower(substr({v}, CAST(i AS INTEGER), 1)) ELSE upper(substr({v}, CAST(i AS INTEGER), 1)) END), '')")


_NOT_ALNUM = r"[^\p{L}\p{N}" + WHITESPACE[1:-2] + r"\p{Z}]"


def _clean(x: str) -> str:
    return _s(f"regexp_replace({_s(x)}, '{_NOT_ALNUM}', '', 'g')")


def _after(line: str) -> str:
    return f"substr({line}, instr({line}, ':') + 1)"


def _kw(text: str, words: list[str]) -> str:
    whens = " ".join(f"WHEN contains({text}, {q(w)}) THEN {q(w.title())}" for w in words)
    return f"(CASE {whens} END)"


def _parse_sql() -> dict[str, str]:
    bu, bs = C.sql_clinical_baseline("c.symptoms")
    valid = ", ".join(q(u) for u in K.URGENCY_RANK)
    kind = lambda p: f"starts_with(lower({_s('l')}), '{p}')"
    return {
        "p0": f"""SELECT r.case_id, r.model, r.model_ord, {bu} AS bu, {bs} AS bs,
            {_s("coalesce(r.raw_text, '')")} AS t0 FROM replies_v r JOIN cases_v c USING (case_id)""",
        "p1": f"""SELECT *, CASE WHEN contains(t0, '<think>') AND contains(t0, '</think>')
            THEN {_s("string_split(t0, '</think>')[2]")} ELSE t0 END AS txt,
            CASE WHEN contains(t0, '<think>') AND contains(t0, '</think>') THEN
              nullif({_s("replace(string_split(t0, '</think>')[1], '<think>', '')")}, '') END AS block FROM p0""",
        "p2": f"""SELECT *,
            list_filter(list_transform(list_filter(string_split(txt, chr(10)), lambda l: {kind('urgency:')}),
                        lambda l: {_title(_clean(_after('l')))}), lambda u: u IN ({valid})) AS uvals,
            list_filter(list_transform(list_filter(string_split(txt, chr(10)), lambda l: {kind('specialty:')}),
                        lambda l: {_clean(_after('l'))}), lambda u: u <> '') AS svals,
            list_filter(string_split(txt, chr(10)), lambda l: NOT ({kind('urgency:')} OR {kind('specialty:')}
                        OR {kind('explanation:')} OR {kind('reasoning:')})) AS kept
            FROM p1""",
        "p3": f"""SELECT case_id, model, model_ord, txt, '<think>' || chr(10) || block || chr(10) || '</think>' AS think,
            coalesce(CASE WHEN len(uvals) > 0 THEN uvals[-1] END, {_kw('lower(txt)', K.REPLY_URGENCY_KEYWORDS)}, bu) AS urgency,
            coalesce(CASE WHEN len(svals) > 0 THEN {_title('svals[-1]')} END,
                     {_kw('lower(txt)', K.REPLY_SPECIALTY_KEYWORDS)}, bs) AS specialty,
            CASE WHEN len(kept) > 0 THEN {_s("array_to_string(kept, chr(10))")} ELSE txt END AS expl0
            FROM p2""",
        "parsed": """SELECT case_id, model, model_ord, urgency, specialty, think,
            CASE WHEN length(expl0) < 10 THEN (CASE WHEN length(txt) > 10 THEN txt
                 ELSE 'Referral to ' || specialty || ' under urgency category ' || urgency || '.' END)
            ELSE expl0 END AS explanation FROM p3""",
    }


def parsed_replies(spark, sf):
    r = V.replies_v(spark, sf)
    c = V.cases_v(spark, sf).select("case_id", "symptoms")
    bu, bs = C.clinical_baseline(F.col("symptoms"))
    j = r.join(c.select("case_id", bu.alias("base_urgency"), bs.alias("base_specialty")), "case_id")
    p = CS.parse_replies(j, "raw_text", "base_urgency", "base_specialty")
    return p.select("case_id", "model", "model_ord", "urgency", "specialty", "explanation", "think")


@register("parse_replies", lambda: ("SELECT case_id, model, urgency, specialty, explanation, think FROM parsed", _parse_sql()))
def parse_replies(spark, sf):
    return parsed_replies(spark, sf).select("case_id", "model", "urgency", "specialty", "explanation", "think")


@register("reply_consensus", lambda: ("""SELECT d.case_id, d.consensus_urgency, d.consensus_specialty,
    m.consensus_models, 'Consensus achieved by ' || m.consensus_models || '.' || chr(10) || chr(10) || m.parts
      AS verified_explanation
    FROM dec d JOIN (SELECT case_id,
        string_agg(CASE WHEN (any_both AND both_) OR (NOT any_both AND on_u) THEN upper(model) END, ', ' ORDER BY model_ord)
          AS consensus_models,
        string_agg(CASE WHEN (any_both AND both_) OR (NOT any_both AND on_u)
                        THEN '[' || upper(model) || ']: ' || explanation END, chr(10) || chr(10) ORDER BY model_ord) AS parts
        FROM mv GROUP BY case_id) m USING (case_id)""", {**_parse_sql(), **_vote_ctes("parsed")}))
def reply_consensus(spark, sf):
    """K6: parse every model reply, then vote per case; the verified
    explanation quotes the agreeing models."""
    m = CS.members(parsed_replies(spark, sf), explanation="explanation")
    return m.select("case_id", "consensus_urgency", "consensus_specialty", "consensus_models", "verified_explanation")
