"""Sources/sinks (CSV, text corpus, Parquet, images, model persistence),
upserts and reconcile, and the Spark ML risk model."""

import os
import struct
import zlib

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from wardlake.operators import images as IM
from wardlake.operators import ml as ML
from wardlake.operators import retrieval as RT
from wardlake.sources import lake as L


def _png(path, w, h, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xffffffff)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_source_metrics_and_findings(spark, tmp_dir):
    _png(os.path.join(tmp_dir, "dark.png"), 4, 3, (10, 20, 30))
    _png(os.path.join(tmp_dir, "gray.png"), 5, 2, (128, 128, 128))
    with open(os.path.join(tmp_dir, "broken.png"), "wb") as f:
        f.write(b"not an image")
    imgs = IM.read_images(spark, tmp_dir)
    m = {os.path.basename(r.origin): r for r in IM.image_metrics(imgs).collect()}
    assert set(m) == {"dark.png", "gray.png"}
    assert m["dark.png"].brightness == pytest.approx(0.299 * 10 + 0.587 * 20 + 0.114 * 30)
    assert m["gray.png"].contrast == pytest.approx(0.0)
    f = {os.path.basename(r.origin): r for r in IM.image_findings(IM.image_metrics(imgs), " MRI ").collect()}
    assert f["dark.png"].category == "abnormal" and f["gray.png"].category == "normal"
    assert f["gray.png"].modality == "mri" and f["gray.png"].confidence == 0.62


def test_text_corpus_and_incremental_index(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "batch1"), os.path.join(tmp_dir, "batch2")
    os.makedirs(a)
    os.makedirs(b)
    for folder, name, text in [(a, "cardiology.txt", "Chest pain guidance.\nSecond line."),
                               (b, "cardiology.txt", "Chest pain guidance.\nSecond line."),
                               (b, "diabetes.txt", "Blood sugar guidance.")]:
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    first = L.read_text_corpus(spark, a)
    assert rows(first, "source", "text") == [("cardiology.txt", "Chest pain guidance.\nSecond line.")]
    second = L.read_text_corpus(spark, b).withColumn("doc_id", F.monotonically_increasing_id())
    new = RT.new_documents(second, first, key="source")
    assert [r.source for r in new.collect()] == ["diabetes.txt"]


def test_reconcile_upsert_and_parquet_roundtrip(spark, tmp_dir):
    old = spark.createDataFrame([(1, "Dr. A", "Cardiology")], "id long, name string, specialty string")
    r = L.reconcile(old, L.DOCTORS_SCHEMA, L.DOCTOR_DEFAULTS).first()
    assert (r.hospital, r.experience, r.available_time, r.available) == ("Texas Health Frisco", 5, None, True)
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    up = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    assert sorted(rows(L.upsert_by_key(base, up))) == [(1, "a"), (2, "B"), (3, "c")]
    pats = spark.createDataFrame([(1, "Ann", "Plano", None), (5, "Bob", "Frisco", "diabetes")],
                                 "id long, name string, location string, medical_history string")
    upd = spark.createDataFrame([("Ann", "", "asthma"), ("Cy", "", None), ("Al", "Plano", None)],
                                "name string, location string, medical_history string")
    got = sorted(rows(L.upsert_patients(pats, upd)))
    assert got == [(1, "Ann", "Plano", "asthma", False), (5, "Bob", "Frisco", "diabetes", False),
                   (6, "Al", "Plano", None, True), (7, "Cy", "", None, True)]
    path = L.write_table(base, os.path.join(tmp_dir, "t"), "overwrite")
    assert sorted(rows(spark.read.parquet(path))) == [(1, "a"), (2, "b")]


def test_csv_typed_and_bad_values(spark, tmp_dir):
    path = os.path.join(tmp_dir, "patients.csv")
    with open(path, "w") as f:
        f.write("patient,age,chest_pain,diabetes,hypertension,shortness_of_breath,blood_pressure,risk\n"
                "Ravi,64,1,1,1,1,158,3\nMaya,58,0,1,1,0,148,2\nBad,x,0,0,0,0,120,1\n")
    raw = spark.read.option("header", True).csv(path)  # strings: one bad number
    clean = ML.training_frame(raw)
    assert clean.count() == 2  # the bad row becomes NULL and is dropped, no ANSI failure
    typed = L.read_csv(spark, path, L.PATIENTS_CSV_SCHEMA)
    assert typed.schema["age"].dataType.simpleString() == "int"


def test_risk_model_train_predict_persist(spark, tmp_dir):
    from wardlake.plans.ml_queries import model_inputs

    data = model_inputs(spark, SF_SMALL)
    model, metrics = ML.train_risk_model(data, "risk", ML.FEATURES, split_key="case_id")
    assert metrics["rows"] == data.count() and 0.0 <= metrics["accuracy"] <= 1.0
    assert [x["feature"] for x in metrics["feature_importance"]] == ML.FEATURES
    path = os.path.join(tmp_dir, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    payload = spark.createDataFrame([(None, True, 0, None, 1, None)],
                                    "age int, chest_pain boolean, diabetes int, hypertension int, "
                                    "shortness_of_breath int, blood_pressure int")
    feats = ML.coerce_features(payload)
    assert tuple(feats.first()) == (55, 1, 0, 0, 1, 120)
    p = ML.predict_risk(loaded, feats).first()
    assert p.prediction_label in ("Low Risk", "Medium Risk", "High Risk", "Emergency")
    assert set(p.probabilities) == {"Low Risk", "Medium Risk", "High Risk", "Emergency"}
    assert 0.0 <= p.risk_score <= 100.0


def test_weighted_risk_and_boosted(spark):
    df = spark.createDataFrame([([0.1, 0.3, 0.6],), ([0.7, 0.2, 0.1],)], "p array<double>")
    w = ML.weighted_risk(F.col("p"))
    got = rows(df.select(*[v.alias(k) for k, v in w.items()]))
    assert got[0] == ("High", 0.6, 0.4, 75.0)
    assert got[1][0] == "Low" and got[1][3] == 20.0
    from wardlake.plans.ml_queries import model_inputs
    data = model_inputs(spark, SF_SMALL).withColumn("label", F.col("risk").cast("double"))
    m = ML.boosted_model(data, ML.FEATURES, "label", max_iter=3)
    scored = ML.boosted_probabilities(m, data).select("label", "probability").collect()
    assert all(len(r.probability) == 3 and abs(sum(r.probability) - 1) < 1e-9 for r in scored)
    right = sum(r.probability.index(max(r.probability)) == r.label for r in scored)
    largest = max(sum(r.label == c for r in scored) for c in (0.0, 1.0, 2.0))
    assert right > largest  # better than always naming the commonest class


def test_seed_if_empty_and_upload_validation(spark):
    from wardlake.operators import matching as M
    seed = M.rules_frame(spark)
    empty = spark.createDataFrame([], seed.schema)
    assert L.seed_if_empty(empty, seed).count() == 9
    one = seed.limit(1)
    assert L.seed_if_empty(one, seed).count() == 1
    ups = spark.createDataFrame([("a", "image/PNG", 10), ("b", "application/pdf", 10), ("c", None, 10),
                                 ("d", "image/jpeg", 30 * 1024 * 1024)], "name string, content_type string, length long")
    assert sorted(r.name for r in L.valid_uploads(ups).collect()) == ["a", "c"]


def test_cosine_is_the_same_in_any_number_of_blocks(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from wardlake.operators import blocks
    from wardlake.sources.tables import table
    emb = table(spark, SF_SMALL, "embeddings")
    qs = emb.select(F.col("vec_id").alias("label"), "embedding")  # every vector is a query here
    width = len(emb.first().embedding)
    def r9(df):
        return sorted((a, b, c, round(d, 9)) for a, b, c, d in rows(df))
    one = r9(RT.cosine_topk(RT.centroids(emb), emb, 3))
    monkeypatch.setattr(blocks, "CELLS", 3 * width)
    assert blocks.write_blocks(RT.centroids(emb), "label", "embedding", True)[1] > 2
    assert r9(RT.cosine_topk(RT.centroids(emb), emb, 3)) == one
    monkeypatch.setattr(blocks, "CELLS", 64 * width)
    big = RT.cosine_topk(qs, emb, 2)
    assert big.count() == 2 * qs.count()
    assert big.filter("rank = 1").filter(F.abs(F.col("score") - 1.0) > 1e-9).count() == 0  # nearest is itself


def test_append_reports_partitioned_and_rules_projection(spark, tmp_dir):
    from wardlake.operators import matching as M
    from wardlake.sources import fixtures as V
    rep = L.enrich_reports(V.cases_v(spark, SF_SMALL))
    path = os.path.join(tmp_dir, "reports")
    L.append_reports(rep, path)
    L.append_reports(rep, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 * rep.count()
    days = back.select("day").distinct().count()
    assert days == rep.select(F.substring("generated_at", 1, 10)).distinct().count()
    one_day = back.filter(F.col("day") == back.first()["day"])
    assert "PartitionFilters" in one_day._jdf.queryExecution().executedPlan().toString()
    proj = M.rules_projection(M.rules_frame(spark))
    assert "id" not in proj.columns and proj.count() == 9


def test_split_date_time_and_dashboard_bundle(spark):
    from wardlake.functions import timefn as T
    from wardlake.operators import dashboard as D
    from wardlake.sources import fixtures as V
    df = spark.createDataFrame([("2026-06-20 2:00 PM",), ("2026-06-21",)], "t string")
    d, t = T.split_date_time(F.col("t"))
    assert rows(df.select(d, t)) == [("2026-06-20", "2:00 PM"), ("2026-06-21", "10:00 AM")]
    b = D.dashboard_bundle(V.reports_v(spark, SF_SMALL), V.appointments_v(spark, SF_SMALL),
                           V.patients_v(spark, SF_SMALL), V.doctors_v(spark, SF_SMALL))
    assert set(b) == {"most_common_disease", "most_busy_doctor", "hospital_load", "emergency_trends", "totals"}
    assert b["totals"].count() == 1


def test_last_update_wins(spark):
    base = spark.createDataFrame([(1, "a")], "id long, v string")
    up = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 1)], "id long, v string, seq int")
    assert sorted(rows(L.upsert_by_key(base, up, order="seq"))) == [(1, "b"), (2, "c")]
    pats = spark.createDataFrame([(1, "P", "Here", None)], "id long, name string, location string, medical_history string")
    upd = spark.createDataFrame([("P", "Plano", "", 1), ("P", "Allen", None, 2), ("P", "", "x", 3)],
                                "name string, location string, medical_history string, seq int")
    got = L.upsert_patients(pats, upd, "seq").first()
    assert (got.location, got.medical_history) == ("Allen", "x")


def test_every_order_has_an_appointment(spark):
    from tests.conftest import SF_SMALL
    from wardlake.sources import fixtures as V

    assert V.appointments_v(spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
