"""Risk models with Spark ML.

Training and scoring are whole-table Spark ML jobs: one ``Pipeline``
(``VectorAssembler`` + classifier) fitted on a DataFrame and applied with
``transform`` to any number of rows; nothing is scored one request at a time.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import constants as K

FEATURES = list(K.SPARK_ML_FEATURES)

# Split key hashing: an LCG step on the key, exact in 64-bit integers, so any
# engine (and any partitioning) puts a row on the same side.
_M31 = 2147483648
_LCG_A, _LCG_C = 1103515245, 12345


def split_bucket(key: Column) -> Column:
    return F.pmod(F.pmod(key, F.lit(_M31)) * _LCG_A + _LCG_C, F.lit(_M31)) % 100


def sql_split_bucket(key: str) -> str:
    return f"((((({key}) % {_M31} + {_M31}) % {_M31}) * {_LCG_A} + {_LCG_C}) % {_M31}) % 100"


def hash_split(df: DataFrame, key: str, train_pct: int = round(K.SPLIT_TRAIN_FRACTION * 100)) -> DataFrame:
    """I2 (reproducible form): ``split`` = 'train' for ~train_pct % of keys."""
    return df.withColumn("split", F.when(split_bucket(F.col(key)) < train_pct, "train").otherwise("test"))


def clinical_flags(text: Column) -> dict[str, Column]:
    """0/1 model inputs from lowered symptom + history text."""
    return {
        "chest_pain": text.contains("chest pain").cast("int"),
        "diabetes": text.contains("diabetes").cast("int"),
        "hypertension": (text.contains("hypertension") | text.contains("high blood pressure")).cast("int"),
        "shortness_of_breath": (text.contains("shortness of breath") | text.contains("breathing")).cast("int"),
    }


def training_frame(df: DataFrame, label: str = "risk", features: list[str] = FEATURES) -> DataFrame:
    """B1/B2: features and label as double (bad values become NULL instead of
    failing under ANSI mode), rows with any NULL dropped."""
    cols = [F.col(c).try_cast("double").alias(c) for c in features] + [F.col(label).try_cast("double").alias(label)]
    return df.select(*cols).dropna()


def coerce_features(df: DataFrame) -> DataFrame:
    """Payload defaults (age 55, blood pressure 120) and flags as 0/1."""
    out = [F.coalesce(F.col("age"), F.lit(K.DEFAULT_AGE)).cast("int").alias("age")]
    for c in ("chest_pain", "diabetes", "hypertension", "shortness_of_breath"):
        out.append(F.coalesce((F.col(c).cast("double") != 0), F.lit(False)).cast("int").alias(c))
    out.append(F.coalesce(F.col("blood_pressure"), F.lit(K.DEFAULT_BP)).cast("int").alias("blood_pressure"))
    keep = [c for c in df.columns if c not in FEATURES]
    return df.select(*keep, *out)


def train_risk_model(df: DataFrame, label: str = "risk", features: list[str] = FEATURES,
                     split_key: str | None = None) -> tuple[PipelineModel, dict]:
    """Fit assembler + random forest (50 trees, depth 5, seed 42) on an
    80 % split (falling back to all rows when a side is empty) and report
    rows, accuracy on the other 20 % and feature importances."""
    data = df.select(*features, label, *([split_key] if split_key else [])).dropna().cache()
    rows = data.count()
    if rows == 0:
        raise ValueError("no training rows")
    if split_key:
        s = hash_split(data, split_key)
        train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    else:
        train, test = data.randomSplit([K.SPLIT_TRAIN_FRACTION, 1 - K.SPLIT_TRAIN_FRACTION], seed=K.RF_SEED)
    if train.isEmpty():
        train = data
    if test.isEmpty():
        test = data
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=K.RF_TREES, maxDepth=K.RF_DEPTH,
                               seed=K.RF_SEED),
    ])
    model = pipe.fit(train)
    acc = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(model.transform(test))
    imp = model.stages[-1].featureImportances
    metrics = {"rows": rows, "accuracy": round(float(acc), 3),
               "feature_importance": [{"feature": f, "importance": round(float(imp[i]), 4)}
                                      for i, f in enumerate(features)]}
    data.unpersist()
    return model, metrics


def predict_risk(model: PipelineModel, df: DataFrame, labels: dict[int, str] = K.SPARK_ML_LABELS) -> DataFrame:
    """Batch prediction with label name, probability map (rounded to
    3) and expected risk = sum(i * p_i) / (n_labels - 1) * 100, rounded to 1."""
    p = model.transform(df).withColumn("_p", vector_to_array("probability"))
    n = len(labels)
    idx = list(range(n))
    prob = F.map_from_arrays(
        F.array(*[F.lit(labels[i]) for i in idx]),
        F.array(*[F.round(F.coalesce(F.try_element_at("_p", F.lit(i + 1)), F.lit(0.0)), 3) for i in idx]))
    expected = F.aggregate(F.transform("_p", lambda v, i: v * i), F.lit(0.0), lambda a, b: a + b)
    name = F.element_at(F.create_map(*[x for i in idx for x in (F.lit(float(i)), F.lit(labels[i]))]), F.col("prediction"))
    return p.select(*df.columns, name.alias("prediction_label"), prob.alias("probabilities"),
                    F.round(expected / (n - 1) * 100, 1).alias("risk_score")).withColumn(
        "prediction_label", F.coalesce("prediction_label", F.lit("Unknown")))


def weighted_risk(prob: Column, classes: list[str] = K.ML_CLASSES) -> dict[str, Column]:
    """Argmax class, p_high*100 + p_medium*50 (rounded 1, capped 99),
    confidence = max p, uncertainty = 1 - max p."""
    mx = F.array_max(prob)
    arg = F.array_position(prob, mx)
    return {
        "ml_risk_prediction": F.element_at(F.array(*[F.lit(c) for c in classes]), arg.cast("int")),
        "confidence": F.round(mx, 3),
        "uncertainty": F.round(1 - F.round(mx, 3), 3),
        "risk_percentage": F.least(F.round(F.element_at(prob, 3) * 100 + F.element_at(prob, 2) * 50, 1), F.lit(99.0)),
    }


def sql_weighted_risk(low: str, medium: str, high: str, classes: list[str] = K.ML_CLASSES) -> dict[str, str]:
    most = f"greatest({low}, {medium}, {high})"
    return {
        "ml_risk_prediction": f"CASE {most} WHEN {low} THEN '{classes[0]}' WHEN {medium} THEN '{classes[1]}' ELSE '{classes[2]}' END",
        "confidence": f"round({most}, 3)",
        "uncertainty": f"round(1 - round({most}, 3), 3)",
        "risk_percentage": f"least(round({high} * 100 + {medium} * 50, 1), 99.0)",
    }


def standardize(df: DataFrame, cols: list[str], key: str, fit_on: DataFrame | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """I8: (x - mean) / population std per column (std 0 -> 1, as the
    original scaler), with the statistics of ``fit_on`` (``df`` by default) and
    the columns ``keep`` carried along.  The 2 x len(cols) statistics are one
    global aggregate (partial per partition), read as literals: no join with a
    one-row table."""
    stats = (df if fit_on is None else fit_on).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = []
    for c in cols:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        s = 1.0 if not s else s
        out.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(key, *(keep or []), *out)


def boosted_model(df: DataFrame, features: list[str], label: str = "label", max_iter: int = 100) -> PipelineModel:
    """Three risk classes with gradient-boosted trees.  Spark's GBT is
    binary, so one-vs-rest over 100-tree, depth-4 binary GBTs, fitted side by side."""
    gbt = GBTClassifier(maxIter=max_iter, maxDepth=4, seed=K.RF_SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                            OneVsRest(classifier=gbt, labelCol=label, featuresCol="features",
                                      parallelism=len(K.ML_CLASSES))]).fit(df)


def boosted_probabilities(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    """``df`` plus the class probabilities: each one-vs-rest probability over their sum."""
    assembler, one_vs_rest = model.stages
    scored = assembler.transform(df)
    parts = []
    for i, part in enumerate(one_vs_rest.models):
        part = part.copy()
        part.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{i}")
        scored = part.transform(scored)
        parts.append(F.element_at(vector_to_array(f"_p{i}"), 2))
    total = sum(parts[1:], parts[0])
    return scored.select(*df.columns, F.array(*[p / total for p in parts]).alias(name))
