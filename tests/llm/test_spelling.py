"""Spelling variants on odd rows and on words one letter apart, against plain Python."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tests.llm import brute
from wardlake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, form string, signature string"


def brute_words(docs):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs):
    n = brute_words(docs)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def word_rows():
    rng = random.Random(3)
    letters = "abceé"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ßÀ×÷éüö", "z" * 4000]
    docs = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = rng.choice(bases[:1 + int(len(bases) * rng.random() ** 2)])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice([rng.choice(letters), "", w[at] + rng.choice(letters)]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        docs.append((i if i % 50 else None, rng.choice([" ", "-", "9", "\n"]).join(words)))
    docs += [(2000 + i, "chainword " * 20 + "chainwords " * 3 + "chainwordsy" * (i % 2)) for i in range(12)]
    return docs + [(1000, None), (1001, ""), (1002, "12 34"), docs[3], docs[3]]


def listed(df):
    return sorted((tuple(r) for r in df.collect()))


@pytest.mark.parametrize("setting", [(1, 5, 30), (1, 5, 1), (3, 1, 4), (2, 3, 10**9)])
def test_variants_brute(spark, monkeypatch, setting):
    for name, value in zip(("FIRST", "SECOND", "HEAVY"), setting):
        monkeypatch.setattr(spelling, name, value)
    docs = word_rows()
    df = spark.createDataFrame([(*d, "w", 1, "f", "s") for d in docs], SCHEMA)
    expected = brute_variants(docs)
    assert len(expected) > 300 and max(r[4] for r in expected) > 3 and any(r[1] != r[2] for r in expected if r[1])
    assert listed(spelling.variants(df)) == expected


def test_sql_on_odd_rows(spark, tmp_dir):
    docs = word_rows()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_dir}/documents.parquet/*.parquet'")
    assert sorted(con.execute(spelling.SQL).fetchall()) == brute_variants(docs)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c"), (None, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert spelling.variants(df).collect() == []


def test_words_one_letter_apart_share_a_signature():
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 12)))
        at = rng.randrange(len(w))
        v = w[:at] + rng.choice(["", "x", w[at] + "b"]) + w[at + 1:]
        a, b = spelling.signature_values([w, v])
        assert (a == b).any()


def test_counts_in_parts(spark, monkeypatch):
    """Words that a task passes on early are summed up all the same."""
    docs = word_rows()
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert dict(listed(spelling.word_counts(df))) == brute_words(docs)
