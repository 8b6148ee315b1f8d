"""Brute-force checks of the distributed operators on small real inputs."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from wardlake.operators import chat as CH
from wardlake.operators import consensus as CS
from wardlake.operators import matching as M
from wardlake.operators import retrieval as RT
from wardlake.operators import scheduling as S
from wardlake.sources import fixtures as V
from wardlake.sources.tables import table
from wardlake.streaming.sessions import next_state

WORD = re.compile(r"(?u)\b\w\w+\b")


def _tfidf_direct(docs, query, k):
    """The query is fitted with the corpus: smooth idf, raw tf, l2 norm."""
    texts = [t for _, t in docs] + [query]
    toks = [Counter(WORD.findall(t.lower())) for t in texts]
    n = len(texts)
    df = Counter(t for c in toks for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}

    def vec(c):
        v = {t: tf * idf[t] for t, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else v

    q = vec(toks[-1])
    scores = [sum(w * q.get(t, 0.0) for t, w in vec(c).items()) for c in toks[:-1]]
    order = sorted(range(len(docs)), key=lambda i: -round(scores[i], 9))  # stable: corpus order on ties
    return [(docs[i][0], round(scores[i], 3)) for i in order[:k]]


def test_tfidf_equals_direct_formula(spark):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, SF_SMALL, "documents").collect())
    qs = table(spark, SF_SMALL, "benchmark")
    got = {}
    for r in RT.tfidf_topk(qs, table(spark, SF_SMALL, "documents"), 3).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, round(r.score, 3)))
    for q in qs.collect():
        expect = _tfidf_direct(docs, q.text or "", 3)
        mine = [(d, s) for _, d, s in sorted(got[q.item_id])]
        assert [s for _, s in mine] == pytest.approx([s for _, s in expect], abs=1e-3)
        assert [d for d, _ in mine] == [d for d, _ in expect]


def test_overlap_equals_brute_force(spark):
    docs = sorted((r.doc_id, set((r.text or "").lower().split())) for r in table(spark, SF_SMALL, "documents").collect())
    got = {}
    for r in RT.overlap_topk(table(spark, SF_SMALL, "benchmark"), table(spark, SF_SMALL, "documents"), 3).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    for q in table(spark, SF_SMALL, "benchmark").collect():
        qw = set((q.text or "").lower().split())
        sc = [(d, len(qw & w)) for d, w in docs]
        exp = [(d, s) for d, s in sorted(sc, key=lambda x: -x[1]) if s > 0][:3]
        assert [(d, s) for _, d, s in sorted(got.get(q.item_id, []))] == exp


def test_cosine_equals_numpy(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    data = [(r.vec_id, r.label, np.array(r.embedding, dtype=np.float64)) for r in emb.collect()]
    got = {}
    for r in RT.cosine_topk(RT.centroids(emb), emb, 3).collect():
        got.setdefault(r.label, []).append((r.rank, r.vec_id, r.score))
    for lab in {x[1] for x in data}:
        c = np.mean([v for _, l, v in data if l == lab], axis=0)
        sc = sorted(((vid, float(c @ v / (np.linalg.norm(c) * np.linalg.norm(v)))) for vid, _, v in data),
                    key=lambda x: (-round(x[1], 9), x[0]))[:3]
        mine = sorted(got[lab])
        assert [v for _, v, _ in mine] == [v for v, _ in sc]
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in sc], abs=1e-9)


def test_booking_invariants(spark):
    req, slots, docs = V.requests_v(spark, SF_SMALL), V.slots_v(spark, SF_SMALL), V.doctors_v(spark, SF_SMALL)
    out = S.book(req, slots, docs)
    acc = out["accepted"]
    assert acc.count() == acc.select("slot_id").distinct().count()  # a slot is never booked twice
    open_ids = {r.slot_id for r in S.open_slots(slots, docs).collect()}
    assert {r.slot_id for r in acc.collect()} <= open_ids
    assert acc.count() + out["rejected"].count() == req.count()
    after = {r.id: r.available for r in out["slots_after"].collect()}
    assert all(after[r.slot_id] == 0 for r in acc.collect())
    # earliest request wins
    first = {}
    for r in req.collect():
        if r.slot_id in open_ids:
            k = (r.requested_at, r.request_id)
            first[r.slot_id] = min(first.get(r.slot_id, k), k)
    assert {r.slot_id: r.request_id for r in acc.collect()} == {s: k[1] for s, k in first.items()}


def test_consensus_is_row_order_free(spark):
    v = V.votes_v(spark, SF_SMALL)
    a = sorted(rows(CS.members(v)))
    b = sorted(rows(CS.members(v.orderBy(F.rand(7)).repartition(5))))
    assert a == b


def test_inline_rule_matcher_equals_qgram_join(spark):
    c = V.cases_v(spark, SF_SMALL)
    st, ht = M.case_texts(F.col("symptoms"), F.col("history"))
    inline = M.rule_match_rows(c, "case_id", st, ht).select("case_id", "rule_id")
    joined = M.match_rules_join(c, "case_id", st, ht, M.rules_frame(spark)).select("case_id", "rule_id")
    assert sorted(rows(inline)) == sorted(rows(joined))


def test_rule_answers_of_a_table_equal_those_of_a_list(spark):
    c = V.cases_v(spark, SF_SMALL)
    st, ht = M.case_texts(F.col("symptoms"), F.col("history"))
    names = ["case_id", "n_rules", "recommended_specialty", "priority", "risk_score", "confidence", "explanation",
             "posterior_risk", "risk_percentage"]
    listed = M.with_rule_scores(c, st, ht).select(*names)
    joined = M.rule_scores_join(c, "case_id", st, ht, M.rules_frame(spark)).select(*names)
    assert sorted(rows(listed)) == sorted(rows(joined))


def test_session_replay_equals_turn_by_turn(spark):
    m = V.messages_v(spark, SF_SMALL)
    f = CH.message_features(m).collect()
    expected, state = {}, {}
    for r in sorted(f, key=lambda r: (r.session_id, r.turn)):
        s = state.get(r.session_id, "general")
        s = next_state(s, r.is_health, r.is_list, r.has_signal, r.hospital_name)
        state[r.session_id] = s
        expected[(r.session_id, r.turn)] = s
    got = {(r.session_id, r.turn): r.state for r in CH.session_states(m).collect()}
    assert got == expected
    assert set(got.values()) == set(CH.STATES)
