"""Softmax boosting: any partitioning gives the same trees; SQL, the node table and the columns agree; the
risk stage takes the model first and the keyword score where there is none."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import boosting as B
from wardlake.operators import matching as M
from wardlake.plans import matching_queries as MQ

FEATURES = ["x", "y", "flag", "same"]
SETTING = B.Setting(rounds=4, depth=3, bins=16, rate=0.5)


def rows(n=600):
    rng = random.Random(5)
    out = []
    for i in range(n):
        x, y, flag = rng.gauss(0, 2), rng.choice([None, *range(9)]), rng.random() < 0.4
        label = 2 if flag and x > 0 else 1 if (y or 0) > 4 else 0
        out.append((i, x, y, int(flag), 7, float(label if rng.random() < 0.97 else rng.randrange(3))))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id long, x double, y int, flag int, same int, label double")


@pytest.fixture(scope="module")
def model(data):
    return B.fit(data.filter("id % 5 > 0"), FEATURES, "label", SETTING)


def probabilities(df, model):
    return {r["id"]: r["probability"] for r in B.with_probabilities(df, model).collect()}


def test_same_trees_on_any_partitions(data, model, monkeypatch):
    monkeypatch.setattr(B, "DIRECT", 1)  # sums are added up in the cluster
    other = B.fit(data.filter("id % 5 > 0").repartition(7, "y"), FEATURES, "label", SETTING)
    for (levels, values), (levels2, values2) in zip(model.trees, other.trees, strict=True):
        assert all((a == b).all() for x, y in zip(levels, levels2, strict=True) for a, b in zip(x, y, strict=True))
        assert (values == values2).all()


def test_sql_twin(data, model):
    con = duckdb.connect()
    con.execute("CREATE TABLE d (id BIGINT, x DOUBLE, y INTEGER, flag INTEGER, same INTEGER, label INTEGER)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?, ?)", [(*r[:5], int(r[5])) for r in rows()])
    con.execute("CREATE VIEW src AS SELECT id, x, y, flag, same, label, id % 5 > 0 AS train FROM d")
    ctes = ", ".join(f"{k} AS ({v})" for k, v in B.sql_fit("src", FEATURES, SETTING).items())
    found = {r[0]: r[1:] for r in con.execute(f"WITH RECURSIVE {ctes} SELECT id, p0, p1, p2 FROM boosted").fetchall()}
    for i, p in probabilities(data, model).items():
        assert p == pytest.approx(found[i], abs=1e-12)


def test_node_table_scores_like_the_columns(spark, data, model):
    nodes = {(r["tree"], r["node"]): r for r in B.node_table(spark, model).collect()}
    assert len(nodes) == SETTING.rounds * (2 ** (SETTING.depth + 1) - 1)
    got = probabilities(data, model)
    for r in data.collect():
        f = np.zeros(3)
        for t in range(SETTING.rounds):
            node = 1
            while nodes[t, node]["value"] is None:
                n = nodes[t, node]
                x = r[n["feature"]] if n["feature"] else None
                node = 2 * node + int(x is not None and x >= n["below"])
            f += nodes[t, node]["value"]
        e = np.exp(f - f.max())
        assert got[r["id"]] == pytest.approx(list(e / e.sum()), abs=1e-9)


def test_held_out_rows(data, model):
    test = data.filter("id % 5 = 0")
    scored = B.with_probabilities(test, model).filter(F.expr("array_position(probability, array_max(probability)) - 1 = label"))
    assert scored.count() >= 0.9 * test.count()
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") <= SETTING.rounds * 2**SETTING.depth + 20  # the filter copies no conditions


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(i, 1.0, 1, 0, 1, 1.0) for i in range(5)] + [(9, 0.0, 1, 0, 1, None)],
                               "id long, x double, y int, flag int, same int, label double")
    m = B.fit(df, FEATURES, "label", SETTING)
    assert all(p[1] > max(p[0], p[2]) for p in probabilities(df, m).values())
    with pytest.raises(ValueError):
        B.fit(df.filter("id > 99"), FEATURES, "label", SETTING)


def test_risk_stage_falls_back_where_there_is_no_model(spark):
    cases = spark.createDataFrame(
        [(1, "chest pain, diabetes", "", 60, 150, 90, 240), (2, "chest pain, diabetes", "", None, 150, 90, 240), (3, "fever", "", 20, 110, 70, 160)],
        "case_id long, symptoms string, history string, age int, bp int, heart_rate int, cholesterol int")
    scored = M.with_rule_scores(cases, *M.case_texts(F.col("symptoms"), F.col("history")))
    train = scored.crossJoin(spark.range(30)).select(*MQ.MQ.case_features(scored).values(), (F.col("case_id") != 3).cast("double").alias("label")).dropna()
    model = B.fit(train.withColumn("label", F.col("label") * 2), MQ.MQ.C.FEATURE_NAMES, "label")
    plain = {r["case_id"]: r for r in MQ.risk_stage(scored).collect()}
    assert [plain[i]["ml_risk_prediction"] for i in (1, 2, 3)] == ["High", "High", "Low"]
    assert [(plain[i]["ml_risk_pct"], plain[i]["ml_confidence"]) for i in (1, 2, 3)] == [(65.0, 0.7), (65.0, 0.7), (0.0, 0.7)]
    by_model = {r["case_id"]: r for r in MQ.risk_stage(scored, model).collect()}
    assert by_model[2]["ml_risk_pct"] == 65.0 and by_model[2]["ml_confidence"] == 0.7
    assert by_model[1]["ml_risk_pct"] > 80 and by_model[1]["ml_confidence"] > 0.8 and by_model[3]["ml_risk_pct"] < 20
    assert by_model[1]["combined_risk"] == round(max(by_model[1]["ml_risk_pct"], by_model[1]["risk_percentage"]), 1)
