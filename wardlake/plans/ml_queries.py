"""Model-input and model queries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from wardlake import constants as K
from wardlake.functions import clinical as C
from wardlake.operators import boosting as BO
from wardlake.operators import ml as ML
from wardlake.plans.registry import register
from wardlake.sources import fixtures as V
from wardlake.sources.tables import data_version, spread, table

_FEATS13 = C.FEATURE_NAMES


def model_inputs(spark, sf):
    """cases_v as the 6-feature model input with its rule-derived risk label."""
    c = V.cases_v(spark, sf)
    text = C.list_text(F.concat_ws(", ", F.col("symptoms"), F.col("history")))
    flags = ML.clinical_flags(text)
    return c.select("case_id", F.col("age"), *[v.alias(k) for k, v in flags.items()],
                    F.col("bp").alias("blood_pressure"),
                    C.risk_label(C.risk_score(F.col("symptoms"), F.col("age"))).alias("risk"))


def _sql_inputs() -> str:
    text = C.sql_list_text("concat_ws(', ', symptoms, history)")
    return (f"""SELECT case_id, age, CAST(contains({text}, 'chest pain') AS INTEGER) AS chest_pain,
        CAST(contains({text}, 'diabetes') AS INTEGER) AS diabetes,
        CAST(contains({text}, 'hypertension') OR contains({text}, 'high blood pressure') AS INTEGER) AS hypertension,
        CAST(contains({text}, 'shortness of breath') OR contains({text}, 'breathing') AS INTEGER) AS shortness_of_breath,
        bp AS blood_pressure, {C.sql_risk_label(C.sql_risk_score('symptoms', 'age'))} AS risk FROM cases_v""")


@register("ml_features_clean", lambda: ("""SELECT TRY_CAST(age AS DOUBLE) AS age, TRY_CAST(chest_pain AS DOUBLE) AS chest_pain,
    TRY_CAST(diabetes AS DOUBLE) AS diabetes, TRY_CAST(hypertension AS DOUBLE) AS hypertension,
    TRY_CAST(shortness_of_breath AS DOUBLE) AS shortness_of_breath, TRY_CAST(blood_pressure AS DOUBLE) AS blood_pressure,
    TRY_CAST(risk AS DOUBLE) AS risk FROM mi
    WHERE age IS NOT NULL AND chest_pain IS NOT NULL AND diabetes IS NOT NULL AND hypertension IS NOT NULL
      AND shortness_of_breath IS NOT NULL AND blood_pressure IS NOT NULL AND risk IS NOT NULL""", {"mi": _sql_inputs()}))
def ml_features_clean(spark, sf):
    return ML.training_frame(model_inputs(spark, sf))


@register("coerce_features", lambda: ("""SELECT case_id, risk, CAST(coalesce(age, 55) AS INTEGER) AS age,
    CAST(coalesce(chest_pain <> 0, false) AS INTEGER) AS chest_pain, CAST(coalesce(diabetes <> 0, false) AS INTEGER) AS diabetes,
    CAST(coalesce(hypertension <> 0, false) AS INTEGER) AS hypertension,
    CAST(coalesce(shortness_of_breath <> 0, false) AS INTEGER) AS shortness_of_breath,
    CAST(coalesce(blood_pressure, 120) AS INTEGER) AS blood_pressure FROM mi""", {"mi": _sql_inputs()}))
def coerce_features(spark, sf):
    return ML.coerce_features(model_inputs(spark, sf))


@register("train_test_split", lambda: f"""SELECT case_id,
    CASE WHEN {ML.sql_split_bucket('case_id')} < 80 THEN 'train' ELSE 'test' END AS split FROM cases_v""")
def train_test_split(spark, sf):
    return ML.hash_split(V.cases_v(spark, sf).select("case_id"), "case_id")


def _std_sql() -> tuple[str, dict]:
    from wardlake.plans.rule_queries import _sql_features_text
    feats = C.sql_risk_feature_columns(_sql_features_text(), "age", "bp", "heart_rate", "cholesterol")
    stats = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in _FEATS13)
    cols = ", ".join(f"round((f.{n} - s.m_{n}) / CASE WHEN coalesce(s.s_{n}, 0) = 0 THEN 1 ELSE s.s_{n} END, 6) AS {n}"
                     for n in _FEATS13)
    return (f"SELECT f.case_id, {cols} FROM feats f CROSS JOIN fstats s",
            {"feats": f"SELECT case_id, {', '.join(feats)} FROM cases_v", "fstats": f"SELECT {stats} FROM feats"})


@register("standardize", _std_sql)
def standardize(spark, sf):
    """The 13 risk features standardised with the population std (rounded
    to 6 decimals for comparison)."""
    from wardlake.plans.rule_queries import _features_text
    c = V.cases_v(spark, sf)
    f = c.select("case_id", *C.risk_feature_columns(_features_text(), "age", "bp", "heart_rate", "cholesterol"))
    z = ML.standardize(f, _FEATS13, "case_id")
    return z.select("case_id", *[F.round(n, 6).alias(n) for n in _FEATS13])


_MODELS: dict = {}


def _fitted(spark, sf, kind: str, fit):
    """A model fitted once per session and state of the files that it learns from."""
    key = (spark.sparkContext.applicationId, sf, kind, data_version(table(spark, sf, "events")))
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def risk_model(spark, sf):
    """The random-forest risk model of all cases' 80 % split."""
    return _fitted(spark, sf, "forest", lambda: ML.train_risk_model(
        model_inputs(spark, sf), "risk", ML.FEATURES, split_key="case_id"))


@register("ml_predictions")
def ml_predictions(spark, sf):
    """Random-forest risk model trained on the 80 % split of all cases and
    applied to the other 20 %: the inputs, label, class probabilities and expected risk.
    (A fitted model, so there is no SQL twin; the driver checks row counts.)"""
    data = model_inputs(spark, sf)
    model, _ = risk_model(spark, sf)
    test = ML.hash_split(data.dropna(), "case_id").filter(F.col("split") == "test").drop("split")
    names = F.create_map(*[F.lit(x) for i, label in K.SPARK_ML_LABELS.items() for x in (label, float(i))])
    return ML.predict_risk(model, test).select(
        "case_id", *ML.FEATURES, "risk", names[F.col("prediction_label")].alias("prediction"), "prediction_label",
        F.map_values("probabilities").alias("probability"), "risk_score")


@register("accuracy")
def accuracy(spark, sf):
    """Rows used and accuracy of the random-forest risk model on its
    held-out 20 % (a fitted model: rows-only check)."""
    model, _ = risk_model(spark, sf)
    scored = model.transform(ML.hash_split(model_inputs(spark, sf).dropna(), "case_id"))
    right = (F.col("prediction") == F.col("risk")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("rows"),
                      F.round(F.avg(F.when(F.col("split") == "test", right)), 3).alias("accuracy"))


def case_features(c) -> dict:
    """The 13 risk features of cases as expressions over ``cases_v``."""
    from wardlake.plans.rule_queries import _features_text
    return dict(zip(_FEATS13, C.risk_feature_columns(_features_text(), "age", "bp", "heart_rate", "cholesterol"), strict=True))


def _labelled_features(spark, sf):
    c = V.cases_v(spark, sf)
    return ML.hash_split(c.select("case_id", *case_features(c).values(), C.risk_label(
        C.risk_score(F.col("symptoms"), F.col("age"))).cast("double").alias("label")), "case_id")


def risk_booster(spark, sf) -> BO.Booster:
    """The boosted three-class risk model, fitted on the 80 % split of all cases (labels by the 0-100 rule
    score: >=70 High, >=40 Medium, else Low).  Trees need no standardised inputs."""
    return _fitted(spark, sf, "booster", lambda: BO.fit(
        _labelled_features(spark, sf).filter(F.col("split") == "train"), _FEATS13, "label"))


def with_ml_risk(c, model: BO.Booster | None):
    """Cases with the model's prediction: ml_probabilities, ml_risk_prediction, ml_confidence, ml_uncertainty, ml_risk_pct; null where a
    feature is missing, or without a model."""
    names = {"ml_risk_prediction": "ml_risk_prediction", "confidence": "ml_confidence", "uncertainty": "ml_uncertainty",
             "risk_percentage": "ml_risk_pct"}
    if model is None:
        none = {n: F.lit(None).cast("string" if n == "ml_risk_prediction" else "double") for n in names.values()}
        return c.withColumns({"ml_probabilities": F.lit(None).cast("array<double>")} | none)
    features = case_features(c)
    known = reduce(and_, [F.col(x).isNotNull() for x in ("age", "bp", "heart_rate", "cholesterol")])
    scored = BO.with_probabilities(c, model, "ml_probabilities", features)
    w = ML.weighted_risk(F.col("ml_probabilities"))
    found = {n: F.when(known, w[k]) for k, n in names.items()}
    return scored.withColumns(found).withColumn("ml_probabilities", F.when(known, F.col("ml_probabilities")))


def ml_risk_ctes() -> dict[str, str]:
    """``ml_risk``: the same model, fitted and applied in SQL."""
    from wardlake.plans.rule_queries import _sql_features_text
    feats = C.sql_risk_feature_columns(_sql_features_text(), "age", "bp", "heart_rate", "cholesterol")
    w = ML.sql_weighted_risk("p0", "p1", "p2")
    return {
        "model_rows": f"""SELECT case_id AS id, {', '.join(feats)}, {C.sql_risk_label(C.sql_risk_score('symptoms', 'age'))} AS label,
            {ML.sql_split_bucket('case_id')} < {round(K.SPLIT_TRAIN_FRACTION * 100)} AS train FROM cases_v""",
        **BO.sql_fit("model_rows", _FEATS13),
        "ml_risk": f"""SELECT id AS case_id, {w['ml_risk_prediction']} AS ml_risk_prediction, {w['confidence']} AS ml_confidence,
            {w['uncertainty']} AS ml_uncertainty, {w['risk_percentage']} AS ml_risk_pct FROM boosted""",
    }


@register("weighted_risk", lambda: (f"""SELECT case_id, ml_risk_prediction, ml_confidence AS confidence, ml_uncertainty AS uncertainty,
    ml_risk_pct AS risk_percentage FROM ml_risk WHERE {ML.sql_split_bucket('case_id')} >= {round(K.SPLIT_TRAIN_FRACTION * 100)}""", ml_risk_ctes()))
def weighted_risk(spark, sf):
    """The boosted risk model on the cases held out: predicted class, confidence,
    uncertainty and weighted risk percentage.  Its SQL twin fits and applies the same trees."""
    c = ML.hash_split(spread(V.cases_v(spark, sf)), "case_id").filter(F.col("split") == "test")
    return with_ml_risk(c, risk_booster(spark, sf)).select(
        "case_id", "ml_risk_prediction", F.col("ml_confidence").alias("confidence"),
        F.col("ml_uncertainty").alias("uncertainty"), F.col("ml_risk_pct").alias("risk_percentage"))


@register("risk_model_accuracy", lambda: ("""SELECT train AS learned, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (ml_risk_prediction = ['Low', 'Medium', 'High'][label + 1]) AS BIGINT) AS n_right
    FROM ml_risk JOIN model_rows ON id = case_id GROUP BY 1""", ml_risk_ctes()))
def risk_model_accuracy(spark, sf):
    """I4 for the boosted model: cases and right predictions, learned from and held out."""
    c = ML.hash_split(spread(V.cases_v(spark, sf)), "case_id")
    label = F.element_at(F.array(*[F.lit(x) for x in K.ML_CLASSES]), C.risk_label(C.risk_score(F.col("symptoms"), F.col("age"))) + 1)
    right = (F.col("ml_risk_prediction") == label).cast("long")
    return (with_ml_risk(c, risk_booster(spark, sf)).groupBy((F.col("split") == "train").alias("learned"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right")))
