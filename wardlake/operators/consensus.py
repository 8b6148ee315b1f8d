"""Model-reply parsing and multi-model consensus.

Votes are one row per (case, model).  Tallies are grouped aggregates with
map-side partial aggregation, the tie-break passes are joins on ``case_id``
(all sides hash-partitioned by case, so Spark reuses one partitioning), and
the only per-case collection is the consensus member list, bounded by the
number of models because (case, model) is de-duplicated first (a later
prediction of the same model replaces the earlier one, as in a dict).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions.clinical import PY_WHITESPACE, pystrip
from wardlake.functions.text import WHITESPACE

# keep letters, digits and whitespace (Python isalnum() / isspace())
_NOT_ALNUM_SPACE = r"[^\p{L}\p{N}" + WHITESPACE[1:-2] + r"\p{Z}]"


_BLANKS = PY_WHITESPACE.replace("\n", "")


def _title(c: Column) -> Column:
    """Every run of letters with a capital first ('3d imaging' -> '3D Imaging')."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), 0), F.initcap), "")


def _after_colon(line: Column) -> Column:
    return line.substr(F.instr(line, ":") + 1, F.length(line) + 1)


def _clean(v: Column) -> Column:
    return pystrip(F.regexp_replace(pystrip(v), _NOT_ALNUM_SPACE, ""))


def _first_keyword(text_lower: Column, words: list[str]) -> Column:
    expr = None
    for w in words:
        cond = text_lower.contains(w)
        expr = F.when(cond, F.lit(w.title())) if expr is None else expr.when(cond, F.lit(w.title()))
    return expr


def parse_replies(df: DataFrame, raw: str, base_urgency: str, base_specialty: str) -> DataFrame:
    """Add urgency, specialty, explanation and think (the reasoning block, null without one)
    parsed from the free-text model reply in column ``raw``.

    The last valid 'urgency:' line and the last non-empty 'specialty:' line
    win; otherwise the first keyword found in the text; otherwise the
    baseline columns.  Prefixed lines are removed from the explanation; a
    short explanation falls back to the whole text or a referral sentence.
    Prefixed lines are found with whole-text regular expressions (no
    per-line lambdas); each intermediate is its own projection, so nothing
    is recomputed.
    """
    d = df.withColumn("_t0", pystrip(F.coalesce(F.col(raw), F.lit(""))))
    think = F.col("_t0").contains("<think>") & F.col("_t0").contains("</think>")
    block = pystrip(F.replace(F.element_at(F.split(F.col("_t0"), "</think>", -1), 1), F.lit("<think>"), F.lit("")))
    d = d.withColumn("think", F.when(think & (block != ""), F.concat(F.lit("<think>\n"), block, F.lit("\n</think>"))))
    d = d.withColumn("_text", F.when(think, pystrip(F.element_at(F.split(F.col("_t0"), "</think>", -1), 2)))
                     .otherwise(F.col("_t0")))
    # Line prefixes, matched on the whole text in UNIX-lines multiline mode
    # (only \n ends a line, as with split('\n')); leading blanks are allowed.
    def prefixed(names: str, value: bool) -> str:
        return rf"(?dmi)^[{_BLANKS}]*(?:{names}):" + ("(.*)$" if value else "")

    d = d.withColumn("_uv", F.filter(F.transform(F.regexp_extract_all("_text", F.lit(prefixed("urgency", True)), 1),
                                                 lambda v: _title(_clean(v))),
                                     lambda v: v.isin(*K.URGENCY_RANK.keys())))
    d = d.withColumn("_sv", F.filter(F.transform(F.regexp_extract_all("_text", F.lit(prefixed("specialty", True)), 1),
                                                 _clean), lambda v: v != ""))
    any_prefix = prefixed("urgency|specialty|explanation|reasoning", False)
    n_lines = F.size(F.split(F.col("_text"), "\n", -1))
    n_prefixed = F.size(F.regexp_extract_all("_text", F.lit(any_prefix), 0))
    kept = pystrip(F.regexp_replace("_text", any_prefix + r".*(?:\n|$)", ""))
    d = d.withColumn("_e0", F.when(n_prefixed < n_lines, kept).otherwise(F.col("_text")))
    d = d.withColumn("_lt", F.lower(F.col("_text")))
    lower_text = F.col("_lt")
    d = d.withColumn("urgency", F.coalesce(F.when(F.size("_uv") > 0, F.element_at("_uv", -1)),
                                           _first_keyword(lower_text, K.REPLY_URGENCY_KEYWORDS), F.col(base_urgency)))
    d = d.withColumn("specialty", F.coalesce(F.when(F.size("_sv") > 0, _title(F.element_at("_sv", -1))),
                                             _first_keyword(lower_text, K.REPLY_SPECIALTY_KEYWORDS),
                                             F.col(base_specialty)))
    expl = F.when(F.length("_e0") < 10, F.when(F.length("_text") > 10, F.col("_text")).otherwise(
        F.concat(F.lit("Referral to "), F.col("specialty"), F.lit(" under urgency category "), F.col("urgency"),
                 F.lit(".")))).otherwise(F.col("_e0"))
    d = d.withColumn("explanation", expl)
    return d.drop("_t0", "_text", "_lt", "_uv", "_sv", "_e0")


def _rank_col(c: Column) -> Column:
    expr = None
    for name, r in K.URGENCY_RANK.items():
        expr = F.when(c == name, F.lit(r)) if expr is None else expr.when(c == name, F.lit(r))
    return expr.otherwise(F.lit(0))


def dedupe_votes(votes: DataFrame) -> DataFrame:
    """One prediction per (case, model), the last by ``seq`` if there is such a
    column, else the greatest row: missing fields take the defaults."""
    v = votes.select("case_id", "model", "model_ord",
                     F.coalesce("urgency", F.lit(K.MISSING_VOTE[0])).alias("urgency"),
                     F.coalesce("specialty", F.lit(K.MISSING_VOTE[1])).alias("specialty"),
                     *[c for c in votes.columns if c not in ("case_id", "model", "model_ord", "urgency", "specialty")])
    row = F.struct(*v.columns)
    rank = F.struct("seq", row) if "seq" in v.columns else row
    return v.groupBy("case_id", "model").agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def tallies(votes: DataFrame) -> DataFrame:
    """(case_id, field, value, votes), for the fields urgency and specialty."""
    ballots = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("urgency", "specialty")]))
    return (dedupe_votes(votes).select("case_id", ballots.alias("b"))
            .groupBy("case_id", F.col("b.field").alias("field"), F.col("b.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("votes")))


def _per_case(votes: DataFrame, extra: list[str]) -> DataFrame:
    """(case_id, vs): the case's votes in model order.  After de-duplication
    a case holds at most one vote per model, so the list is bounded by the
    number of models, whatever the number of cases or their skew."""
    v = dedupe_votes(votes)
    fields = ["model_ord", "model", "urgency", "specialty"] + [c for c in extra if c in v.columns]
    return v.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("vs"))


def _decide(df: DataFrame) -> DataFrame:
    """Consensus urgency / specialty from the per-case vote list ``vs``."""
    vs = F.col("vs")

    def n_u(x):
        return F.size(F.filter(vs, lambda y: y["urgency"] == x["urgency"]))

    def n_s(x):
        return F.size(F.filter(vs, lambda y: y["specialty"] == x["specialty"]))

    d = df.withColumn("consensus_urgency", F.array_max(F.transform(
        vs, lambda x: F.struct(n_u(x).alias("n"), _rank_col(x["urgency"]).alias("r"), x["urgency"].alias("u"))))["u"])
    d = d.withColumn("_sc", F.transform(vs, lambda x: F.struct(n_s(x).alias("n"), x["specialty"].alias("s"),
                                                               x["model_ord"].alias("o"), x["urgency"].alias("u"))))
    d = d.withColumn("_mx", F.array_max(F.transform("_sc", lambda x: x["n"])))
    d = d.withColumn("_win", F.array_distinct(F.transform(F.filter("_sc", lambda x: x["n"] == F.col("_mx")),
                                                          lambda x: x["s"])))
    # tie: most-voted specialty among models that voted the consensus urgency, earliest model first
    tie = F.array_max(F.transform(F.filter("_sc", lambda x: x["u"] == F.col("consensus_urgency")),
                                  lambda x: F.struct(x["n"].alias("n"), (-x["o"]).alias("o"), x["s"].alias("s"))))["s"]
    d = d.withColumn("consensus_specialty", F.when(F.size("_win") == 1, F.element_at("_win", 1))
                     .otherwise(F.coalesce(tie, F.element_at("_win", 1))))
    return d.drop("_sc", "_mx", "_win")


def consensus(votes: DataFrame) -> DataFrame:
    """Per case the consensus urgency and specialty.

    Urgency: most votes; a tie goes to the most severe.  Specialty: most
    votes; on a tie, the specialty with most votes among the models that
    voted the consensus urgency (earliest such model first).
    """
    return _decide(_per_case(votes, [])).select("case_id", "consensus_urgency", "consensus_specialty")


def members(votes: DataFrame, explanation: str | None = None) -> DataFrame:
    """Consensus plus the models agreeing on both values (else on
    the urgency) in model order, live-model count and, when an explanation
    column is given, the verified explanation text."""
    d = _decide(_per_case(votes, ["mode"] + ([explanation] if explanation else [])))
    both = F.filter("vs", lambda x: (x["urgency"] == F.col("consensus_urgency"))
                    & (x["specialty"] == F.col("consensus_specialty")))
    on_u = F.filter("vs", lambda x: x["urgency"] == F.col("consensus_urgency"))
    d = d.withColumn("_mem", F.when(F.size(both) > 0, both).otherwise(on_u))
    names = F.array_join(F.transform("_mem", lambda x: F.upper(x["model"])), ", ")
    has_mode = "mode" in votes.columns
    live = F.size(F.filter("vs", lambda x: x["mode"] == "live")) if has_mode else F.lit(0)
    cols = ["case_id", "consensus_urgency", "consensus_specialty", names.alias("consensus_models"),
            live.cast("int").alias("live_models_count"), (live > 0).alias("live_mode")]
    if explanation:
        parts = F.transform("_mem", lambda x: F.concat(F.lit("["), F.upper(x["model"]), F.lit("]: "),
                                                      F.coalesce(x[explanation], F.lit("None"))))
        cols.append(F.concat(F.lit("Consensus achieved by "), names, F.lit(".\n\n"),
                             F.array_join(parts, "\n\n")).alias("verified_explanation"))
    return d.select(*cols)
