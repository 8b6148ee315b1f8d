"""Saved reports and chats (a batch saved twice, a run lost on the way, names, details,
left-out fields) and keyed tables (merges rewrite only touched partitions)."""

import json
import os

from pyspark.sql import functions as F

from tests.conftest import rows
from wardlake.sources import lake as L
from wardlake.sources import store as ST

SAVES = ("save_id long, patient_name string, hospital string, symptoms string, specialty string, risk_score int, "
         "priority string, recommendation string, details map<string,string>, generated_at string")


def saves(spark, *some):
    return spark.createDataFrame([(i, name, "H", "fever, cough", "Pulmonology", 10, "Routine", "rest", details, "2024-01-01T00:00:00")
                                  for i, name, details in some], SAVES)


def reports(spark, store):
    return ST.stored(spark, f"{store}/reports", ST.REPORTS)


def patients(spark, store):
    return sorted(rows(ST.stored(spark, f"{store}/patients", ST.PATIENTS), "id", "name"))


def test_a_batch_saved_twice_adds_nothing(spark, tmp_dir):
    one = saves(spark, (1, "Ann", {"a": "x", "b": None}), (2, "Bob", None), (3, "Ann", {}), (4, None, None), (5, "", None))
    assert ST.save_reports(one, tmp_dir, "b/1 =") and not ST.save_reports(one, tmp_dir, "b/1 =")
    assert patients(spark, tmp_dir) == [(1, "Ann"), (2, "Bob"), (3, "Patient")]
    got = {r["save_id"]: r for r in reports(spark, tmp_dir).collect()}
    assert {i: r["patient_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 3, 5: 3}
    assert json.loads(got[1]["details"]) == {"a": "x", "b": None} and got[2]["details"] == got[3]["details"] == "{}"
    assert got[1]["disease"] == "Respiratory Infection" and got[1]["batch"] == "b/1 ="
    assert ST.save_reports(saves(spark, (6, "Zoe", None), (7, "Bob", None), (8, "Abe", None)), tmp_dir, "b2")
    assert patients(spark, tmp_dir)[3:] == [(4, "Abe"), (5, "Zoe")] and reports(spark, tmp_dir).count() == 8


def test_a_lost_run_is_taken_up(spark, tmp_dir):
    one = saves(spark, (1, "Ann", None), (2, "Bob", None))
    ST.get_or_create_patients(one.select(F.col("patient_name").alias("name")), tmp_dir)  # lost before its reports
    assert ST.save_reports(one, tmp_dir, "b1")
    assert patients(spark, tmp_dir) == [(1, "Ann"), (2, "Bob")]
    assert sorted(rows(reports(spark, tmp_dir), "save_id", "patient_id")) == [(1, 1), (2, 2)]


def test_first_patient_of_a_name_and_empty_batches(spark, tmp_dir):
    L.write_table(spark.createDataFrame([(9, "Ann", "x", None), (4, "Ann", None, None)], ST.PATIENTS), f"{tmp_dir}/patients")
    assert ST.save_reports(saves(spark), tmp_dir, "none") and reports(spark, tmp_dir).count() == 0
    assert ST.save_reports(saves(spark, (1, "Ann", None), (2, "New", None)), tmp_dir, "b")
    assert sorted(rows(reports(spark, tmp_dir), "save_id", "patient_id")) == [(1, 4), (2, 10)]


def test_chats_leave_bulky_fields_out(spark, tmp_dir):
    shape = ("session_id string, turn long, message string, timestamp string, response struct<reply:string,risk:int,note:string,"
             "xai_details:string,rag_medical_context:string,kg_relationships:array<string>>")
    t = spark.createDataFrame([("s", 1, "m", "t1", ("hello", 1, None, "x", "y", ["z"])), ("s", 2, "m", "t2", ("", 7, None, "x", "y", ["z"])),
                               ("s", 3, "m", "t3", (" ", 1, None, "x", "y", ["z"])), (None, 1, "m", "t", ("hi", 1, None, "x", "y", ["z"])),
                               ("", 1, "m", "t", ("hi", 1, None, "x", "y", ["z"])), ("q", 1, None, None, (None, None, None, None, None, None))], shape)
    assert ST.save_chats(t, tmp_dir, "b") and not ST.save_chats(t, tmp_dir, "b")
    got = {(r["session_id"], r["turn"]): r for r in ST.stored(spark, f"{tmp_dir}/chat_history", ST.CHATS).collect()}
    assert set(got) == {("s", 1), ("s", 2), ("s", 3), ("q", 1)}
    assert got["s", 1]["reply"] == "hello" and got["s", 3]["reply"] == " " and got["s", 1]["patient_id"] == 1
    assert json.loads(got["s", 2]["reply"]) == {"reply": "", "risk": 7, "note": None}
    assert got["q", 1]["timestamp"] is None and got["q", 1]["message"] is None


def files(path):
    return {part: sorted(os.listdir(f"{path}/{part}")) for part in os.listdir(path) if part.startswith("part=")}


def test_merge_rewrites_only_touched_partitions(spark, tmp_dir):
    base = spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("name"))
    t = ST.KeyedTable(spark, f"{tmp_dir}/t", "id", base.schema, parts=16)
    t.write(base)
    before = files(t.path)
    new = spark.createDataFrame([(7, "seven"), (7, "six"), (9000, "more")], "id int, name string")
    touched = t.merge(new)
    after = files(t.path)
    assert 1 <= len(touched) <= 2 and {p for p in after if after[p] != before.get(p)} == {f"part={p}" for p in touched}
    want = sorted(rows(L.upsert_by_key(base, new.withColumn("id", F.col("id").cast("long")), "id")))
    assert sorted(rows(t.read(), "id", "name")) == want
    assert t.merge(new) == touched and sorted(rows(t.read(), "id", "name")) == want
    assert t.merge(new.limit(0)) == [] and t.read().count() == 501


def test_patients_merge_equals_upsert(spark, tmp_dir):
    base = spark.createDataFrame([(i, f"p{i}", "here", None) for i in range(1, 60)], ST.PATIENTS)
    new = spark.createDataFrame([(None, "p3", "", "flu"), (None, "p4", "there", ""), (None, "p4", "", ""), (None, "x", None, None), (None, "a", "y", "z")],
                                ST.PATIENTS)
    t = ST.KeyedTable(spark, f"{tmp_dir}/p", "name", base.schema, parts=8)
    t.write(base)
    ST.merge_patients(t, new)
    ST.merge_patients(t, new)
    got = sorted(rows(t.read(), "id", "name", "location", "medical_history"), key=repr)
    assert got == sorted(rows(L.upsert_patients(base, new.drop("id")).drop("is_new")), key=repr)
    assert {r[1]: r[0] for r in got if r[0] > 59} == {"a": 60, "x": 61}


def test_dense_index_over_many_partitions(spark):
    got = rows(L.dense_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"], "n", 10), "k", "n")
    assert sorted(got) == [(k, k + 11) for k in range(1000)]
    assert L.dense_index(spark.range(0), ["id"], "n", 0).count() == 0
