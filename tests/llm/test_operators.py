"""Every training-data operator on odd rows and on the small tables, against SQL or brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import brute
from wardlake.llm import (decontaminate, exact_dedup, language_id, license_scan, line_dedup, minhash_dedup, mixing, queries,
                          suffix_dedup, token_counts, token_output)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.odd_rows(), brute.SCHEMA)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in brute.odd_rows()]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, brute.PASSAGE), (2, "Alpha, beta"), (3, None), (4, "?!"), (1, brute.PASSAGE), (None, "été où")],
                                 "item_id long, text string")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_output.tokenizer_path())


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(spark, sf):
    return sorted((r["doc_id"], r["text"]) for r in docs_of(spark, sf).select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_on_small_tables(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert brute.ordered(df.select(*columns).collect()) == brute.ordered(cur.fetchall())


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op9_mixing"])
def test_sql_on_odd_rows(spark, odd, tmp_dir, name):
    odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "source").write.parquet(f"{tmp_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/documents.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, tmp_dir)
    cur = con.execute(queries.ORACLE[name])
    assert brute.ordered(df.select(*[c[0] for c in cur.description]).collect()) == brute.ordered(cur.fetchall())


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup_repeated_rows(spark, odd, tmp_dir, monkeypatch, hot):
    """Of rows that repeat doc_id and text one stays, as in the SQL; null ids come last."""
    twice = odd.select("doc_id", "text")
    twice = twice.unionByName(twice).unionByName(spark.createDataFrame([(30, "a b"), (30, "a b"), (31, "ab"), (29, "a\tb")], "doc_id long, text string"))
    twice.write.parquet(f"{tmp_dir}/documents.parquet")
    docs = docs_of(spark, tmp_dir)
    if hot:
        keys = [r["key"] for r in exact_dedup._keyed(docs).select("key").distinct().limit(6).collect()]
        monkeypatch.setattr(exact_dedup, "hot_keys", lambda docs: keys)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/documents.parquet/*.parquet')")
    cur = con.execute(exact_dedup.SQL)
    found = exact_dedup.exact_dedup(docs).select(*[c[0] for c in cur.description]).collect()
    assert brute.ordered(found) == brute.ordered(cur.fetchall())
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})


def test_language_stage_without_a_model(odd):
    texts = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = sorted(r["doc_id"] or 0 for r in language_id.known_language(texts).collect())
    assert kept == sorted(r[0] or 0 for r in brute.odd_rows() if any(c.isalpha() for c in r[1] or ""))


def test_empty_tables(spark, odd, bench):
    none = odd.limit(0)
    for found in (decontaminate.digest(none, bench), language_id.digest(none), suffix_dedup.digest(none), exact_dedup.exact_dedup(none),
                  token_counts.digest(none), minhash_dedup.digest(none), line_dedup.digest(none), mixing.taken(none), mixing.mix(none),
                  license_scan.digest(none, license_scan.template_table(spark)), token_output.output(none)):
        assert found.collect() == []
    assert decontaminate.digest(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_stages_keep_all_columns_and_take_effect(spark, odd, bench, tmp_dir):
    bench.write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tmp_dir)
        assert docs.columns == odd.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 0
    left = corpus_pipeline.STAGES[-1][1](spark, docs, tmp_dir)
    assert left.count() == docs.count()


# 1
def test_decontamination_brute(spark, odd, pairs, bench):
    items = [(r[0] if r[0] is not None else "null", r[1]) for r in bench.collect()]
    want = brute.ordered(brute.contamination(pairs, items))
    assert brute.ordered(decontaminate.digest(odd, bench).collect()) == want
    # a benchmark above the bound of the broadcast: several passes, same hits
    many = decontaminate.scan(odd, bench, ["doc_id"], limit=1).selectExpr("row.doc_id", "n_words", "n_hit", "size(items) n")
    assert brute.ordered(many.collect()) == brute.ordered((a, b, c, d) for a, b, c, d, *_ in want)


def test_span_removal(spark):
    docs = spark.createDataFrame([(1, "Before. " + brute.PASSAGE + "é after"), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, brute.PASSAGE)], "item_id long, text string")
    got = dict(decontaminate.remove_spans(docs, bench).collect())
    assert got == {1: "Before.  é after", 2: "clean", 3: None}
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()] == [2, 3]


# 2
def test_language_accuracy_and_unknown(spark, odd):
    got = queries.QUERIES["op2_language_id"](spark, SF_MID).join(docs_of(spark, SF_MID).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in language_id.digest(odd).collect()}
    assert {i for i, r in by_id.items() if r["lang_pred"] == "und"} == {1, 2, 3, 11, 20}
    assert language_id.digest(odd.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und'").count() == 0


def test_codewords_part_languages():
    for k in (2, 4, 7, 12):
        codes = language_id.codewords(k)
        apart = min((codes[i] != codes[j]).sum() for i in range(k) for j in range(i))
        assert apart >= (2 ** (k - 2) if k <= 7 else 10)


# 3
@pytest.mark.parametrize("chunk", [20_000, 1])
def test_suffix_dedup_brute(spark, odd, pairs, chunk):
    assert brute.ordered(suffix_dedup.digest(odd, chunk=chunk).collect()) == brute.ordered(brute.repeats(pairs, 400))


@pytest.mark.parametrize("chunk", [20_000, 2])
def test_suffix_dedup_short_matches(spark, chunk):
    rng = np.random.default_rng(3)
    docs = [(i, "".join(rng.choice(list("abé"), rng.integers(0, 60)))) for i in range(60)]
    got = suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string"), match=9, reach=4, chunk=chunk)
    assert brute.ordered(got.collect()) == brute.ordered(brute.repeats(docs, 9))


def test_suffix_dedup_frequent_key(spark, monkeypatch):
    docs = [(i, f"start {i * 7919} " + "one line comes again\n" * 40 + f"end {i * 104729}") for i in range(40)]
    parts, stage = {}, suffix_dedup.stage

    def seen(df, name):
        at = df.select("key", F.spark_partition_id().alias("part")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))
        parts[name] = at.orderBy(F.desc("n")).first()
        return stage(df, name)

    monkeypatch.setattr(suffix_dedup, "stage", seen)
    conf = {"spark.sql.files.minPartitionNum": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # larger tables join by a shuffle
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), chunk=30).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert brute.ordered(got) == brute.ordered(brute.repeats(docs, 400))
    assert parts["shared-anchors"]["n"] > 30 and parts["shared-anchors"]["parts"] > 1


def test_suffix_dedup_small_table(spark):
    docs = texts_of(spark, SF_SMALL)
    assert brute.ordered(queries.QUERIES["op3_suffix_dedup"](spark, SF_SMALL).collect()) == brute.ordered(brute.repeats(docs, 400))


# 4
def test_exact_dedup_hot_text(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id doc_id", "case when id % 3 > 0 then concat('same', repeat(' ', id % 5)) else concat('t', id) end text")
    normal = brute.ordered(exact_dedup.exact_dedup(docs).collect())
    assert exact_dedup.hot_keys(docs)
    monkeypatch.setattr(exact_dedup, "hot_keys", lambda docs: [])
    assert brute.ordered(exact_dedup.exact_dedup(docs).collect()) == normal
    kept = [r for r in normal if r[3] and r[2] > 1]
    assert len(kept) == 1 and kept[0][0] == kept[0][1] == 4
    assert kept[0][4] == hashlib.sha256(b"same").hexdigest()


# 5
def test_token_counts_brute(spark, tokenizer):
    docs = docs_of(spark, SF_SMALL).select("doc_id", "source", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_token_counts"](spark, SF_SMALL).collect()}
    for d, source, text in docs:
        n = len(text)
        new = text[:n // 3] + source + " " + text[n // 3:2 * n // 3] + text[2 * n // 3 + 50:]
        count = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text, new)]
        assert [got[d]["tokens_before"], got[d]["tokens_after"]] == count
        assert got[d]["leaves_encoded"] <= 6


def test_token_counts_random_edits(spark, tokenizer):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        text = "".join(rng.choice(list("ab é\n."), rng.integers(0, 900)))
        edits = [(int(a), int(a + rng.integers(0, 300)), "".join(rng.choice(list("xy "), rng.integers(0, 5)))) for a in rng.integers(0, 950, 4)]
        rows.append((i, text, edits))
    rows.append((100, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    state = token_counts.counted(docs).select("row.*", "leaves", "tree")
    got = {r["row"]["doc_id"]: r for r in token_counts.apply_edits(state, ["doc_id"]).collect()}
    for i, text, edits in rows:
        out, at = "", 0
        text = text or ""
        for a, b, new in sorted((min(a, len(text)), min(b, len(text)), t) for a, b, t in edits or []):
            a, b = max(a, at), max(a, at, b)
            out, at = out + text[at:a] + new, b
        out += text[at:]
        assert got[i]["text"] == out
        assert got[i]["tree"][1] == len(tokenizer.encode(out, add_special_tokens=False).ids)
        assert sum(got[i]["leaves"]) == len(out.encode())


# 6
def test_near_dedup_brute(odd, pairs):
    assert brute.ordered(minhash_dedup.digest(odd).collect()) == brute.ordered(brute.near_components(pairs))
    assert brute.ordered(minhash_dedup.digest(odd, 5).collect()) == brute.ordered(brute.near_components(pairs, 5))


def test_near_dedup_large_nodes(spark):
    """Nodes that branch further, down to the last round, lose no link."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(120):
        text = [w if rng.random() > 0.06 else f"w{rng.integers(1e6)}" for w in base]
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.ordered(brute.near_components(docs))
    for small, rounds in ((256, 3), (2, 0)):
        got = minhash_dedup.groups(df, 2, small=small, rounds=rounds).selectExpr("doc_id", "n_shingles", "component_id", "doc_id = component_id")
        assert brute.ordered(got.collect()) == want


def test_near_dedup_keeps_links_in_deep_nodes(spark):
    """Pairs just above the threshold among texts that share a passage: their nodes are large
    for three rounds, and no link is lost."""
    shared, docs = [f"b{i}" for i in range(84)], []
    for i in range(200):
        own = [f"o{i}x{j}" for j in range(16)]
        other = list(own)
        for j in (1, 4, 7, 10, 13):
            other[j] = f"c{i}x{j}"
        docs += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + other))]
    want = brute.ordered(brute.near_components(docs))
    linked = sum(not r[3] for r in want)
    assert linked == 200
    got = minhash_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), 2, small=2, rounds=3)
    got = got.selectExpr("doc_id", "n_shingles", "component_id", "doc_id = component_id").collect()
    assert brute.ordered(got) == want
    assert all(minhash_dedup.missed(0.8, rounds) < 6e-5 for rounds in range(4))


def test_keep_one(odd):
    kept = minhash_dedup.keep_one(odd).collect()
    ids = sorted((r["doc_id"] or 0) for r in kept)
    assert len(ids) == len(set(ids)) and 8 not in ids and 5 not in ids and 1 in ids and 2 in ids


# 7
@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_brute(spark, edits):
    rng = np.random.default_rng(7)
    docs = [(i, "\n".join("".join(rng.choice(list("abé"), rng.integers(0, 9))) for _ in range(5))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, " \n\t")]
    got = line_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string"), edits)
    assert brute.ordered(got.collect()) == brute.ordered(brute.line_counts(docs, edits))


def test_line_dedup_odd_rows(odd):
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.digest(odd).collect()}
    assert got[17] == (4, 1, 1) and got[1] == got[2] == got[3] == (0, 0, 0)


def test_line_dedup_texts(spark):
    docs = [(1, "one line here\n\nlast\none line here"), (2, "one line hare\n \nother\nlast\n"), (3, None), (4, "other"), (None, "new\nother")]
    df = spark.createDataFrame([(t, d, "s") for d, t in docs], "text string, doc_id long, source string")
    got = line_dedup.dedup(df)
    assert got.columns == df.columns
    want = {1: "one line here\n\nlast", 2: " \nother\n", 3: None, 4: "", None: "new"}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    hashes = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.result(df).collect()}
    assert hashes == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in want.items()}


def test_line_dedup_edits_by_length(spark):
    rng = np.random.default_rng(77)
    bases = ["".join(rng.choice(list("abé"), n)) for n in (12, 30, 38, 39, 40, 41, 42, 70, 300)]
    lines = [f"{'long boilerplate ' * 9}Page {n} of 30" for n in (12, 47)]
    for base in bases:
        lines.append(base)
        for k in (1, 1, 2, 2, 2, 3):
            new = list(base)
            for _ in range(k):
                at = int(rng.integers(len(new)))
                new[at:at + int(rng.integers(2))] = ["x"] * int(rng.integers(2))
            lines.append("".join(new))
    limit = lambda n: int(line_dedup.limits(np.array(n), None))
    want, seen = [], []
    for i, x in enumerate(lines):
        near = x not in seen and any(brute.distance(x, y) <= limit(min(len(x), len(y))) for y in seen if abs(len(x) - len(y)) <= 3)
        want.append((i, 1, int(x in seen), int(near)))
        seen.append(x)
    assert want[1] == (1, 1, 0, 1) and limit(300) == 2
    got = line_dedup.digest(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert brute.ordered(got.collect()) == brute.ordered(want)


def test_edit_distance():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(2))
        for k in (1, 2, 3):
            assert line_dedup.distance_within(a, b, k) == (brute.distance(a, b) <= k)


# 8
def test_license_scan(spark, odd):
    templates = license_scan.template_table(spark)
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("furnished", "given").replace("free of charge, ", "").replace("copies of the", "copies of all the")
    docs = spark.createDataFrame([(1, f"x y. {changed} z"), (2, mit[:200]), (3, f"{mit}\n{mit}"), (4, "released the mit"), (5, None)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.digest(docs, templates).collect()}
    assert got[1]["licenses"] == "MIT" and 0.9 < got[1]["best_coverage"] < 1
    assert got[2]["n_matches"] == got[4]["n_matches"] == got[5]["n_matches"] == 0
    assert got[3]["n_matches"] == 2 and got[3]["best_coverage"] == 1
    first, second = got[3]["matches"]
    assert first["first"] == 0 and first["end"] == second["first"]
    named = {r["doc_id"]: r["licenses"] for r in license_scan.digest(odd, templates).collect()}
    assert named[19] == "MIT-statement" and named[7] == ""


def licenses_in(text):
    data = text.encode()
    return license_scan.Scanner(license_scan.TEMPLATES)(data, np.array([0, len(data)]))[0]


def test_license_texts_and_neighbours():
    assert sum(len(t.encode()) for t in license_scan.TEMPLATES.values()) < license_scan.MAX_TEMPLATE_BYTES
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():  # each is found as itself, and nothing else beside it
        data = f"Some words. {text} Some more.".encode()
        found = scanner(data, np.array([0, len(data)]))[0]
        assert [(x["license"], x["coverage"]) for x in found] == [(name, 1)], name
    for text, name in (("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
                       ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0")):
        assert [x["license"] for x in licenses_in(text)] == [f"{name}-statement"]


def test_license_text_with_words_put_in():
    words = license_scan.TEMPLATES["MIT"].split()
    for k in (13, 60):
        found = licenses_in(" ".join(words[:80] + [f"x{i}" for i in range(k)] + words[80:]))
        assert [(x["license"], x["coverage"]) for x in found] == [("MIT", 1)]
    found = licenses_in(" ".join(words[:80] + words[96:]))
    assert [x["license"] for x in found] == ["MIT"] and found[0]["coverage"] > 0.88
    found = licenses_in("Released under the MIT License. " * 3)
    assert [(x["license"], x["first"]) for x in found] == [("MIT-statement", 0), ("MIT-statement", 5), ("MIT-statement", 10)]


def test_license_statements_in_full():
    for text in ("Released under the Foo License.", "released under the company license terms", "Licensed under CC BY 3.5.",
                 "This work is not licensed under the MIT License.", "Not released under the MIT License.",
                 "This work is not licensed under the GNU General Public License, version 3.", "under the License", "MIT License"):
        assert licenses_in(text) == [], text
    for text, name in (("It is licensed under the MIT License.", "MIT-statement"), ("RELEASED under the  MIT license", "MIT-statement"),
                       ("Released under the Foo License. Released under the MIT License.", "MIT-statement"),
                       ("It is not free. You may use it: licensed under CC BY 3.0.", "CC-BY-3.0-statement")):
        assert [x["license"] for x in licenses_in(text)] == [name], text


def test_license_scan_small_table(spark):
    wanted = {k: v.lower().rstrip(".") for k, v in license_scan.TEMPLATES.items() if k.endswith("statement")}
    got = {r["doc_id"]: r["licenses"].split(",") for r in queries.QUERIES["op8_license_scan"](spark, SF_MID).collect()}
    for d, text in texts_of(spark, SF_MID):
        plain = " ".join(re.split(r"\s+", text.lower()))
        assert all(k in got[d] for k, v in wanted.items() if v in plain)


# 9
def test_mix_follows_taken(spark):
    docs = docs_of(spark, SF_MID)
    taken = {r["doc_id"]: r for r in mixing.taken(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert all(r["taken"] == counts.get(d, 0) * r["size"] for d, r in taken.items())
    assert max(counts.values()) <= 3
    by_source = {}
    for d, s in docs.select("doc_id", "source").collect():
        by_source.setdefault(s, []).append(taken[d])
    for rows in by_source.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.05 * rows[0]["target"] + max(r["size"] for r in rows)


# 10
def test_token_output_brute(spark, odd, pairs, tokenizer):
    docs = texts_of(spark, SF_SMALL)
    got = queries.QUERIES["op10_token_output"](spark, SF_SMALL).collect()
    assert brute.ordered(got) == brute.ordered(brute.token_rows(docs, tokenizer))
    unique = sorted((d, t) for d, t in dict(pairs).items() if d is not None)
    got = token_output.output(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    assert brute.ordered(got) == brute.ordered(brute.token_rows(unique, tokenizer))
    assert token_output.output(odd).count() == len(pairs)


def test_block_code_round_trip():
    rng = np.random.default_rng(9)
    for n in (0, 1, 511, 512, 513, 600_000):
        ids = np.minimum(rng.geometric(0.01, n), 60_000).astype(np.uint32)
        some, counts = np.unique(ids if n else np.array([5]), return_counts=True)
        coder = token_output.Coder(some, token_output.scaled(some, counts))
        words, states, checkpoints = coder.encode(ids)
        assert (coder.decode(words, states, n) == ids).all()
        parts = len(checkpoints) // (8 * (token_output.LANES + 1))
        assert parts == max(0, -(-n // token_output.LANES) - 1) // token_output.CHECK_STEPS
        for part in range(1, parts + 1):
            tail = ids[part * token_output.CHECK_STEPS * token_output.LANES:]
            assert (coder.decode(words, states, n, checkpoints, part) == tail).all()


def test_damaged_block_is_found(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "some words here"), (2, "and others")], "doc_id long, text string")
    token_output.write_tokens(docs, f"{tmp_dir}/a")
    blocks = spark.read.parquet(f"{tmp_dir}/a/blocks")
    blocks.withColumn("words_crc32", blocks.words_crc32 + 1).write.parquet(f"{tmp_dir}/b/blocks")
    spark.read.parquet(f"{tmp_dir}/a/frequencies").write.parquet(f"{tmp_dir}/b/frequencies")
    with pytest.raises(Exception, match="damaged"):
        token_output.read_tokens(spark, f"{tmp_dir}/b").collect()


# pipeline
def test_pipeline_brute(spark, tokenizer):
    rows = {r["doc_id"]: r for r in docs_of(spark, SF_SMALL).collect()}
    docs = sorted((d, r["text"]) for d, r in rows.items() if re.search(r"[^\W\d_]", r["text"]))
    docs = [(d, rows[d]["text"]) for d, _, _, kept in brute.near_components(docs, 5) if kept]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(d, t) for (d, t), r in zip(docs, brute.contamination(docs, items), strict=True) if not r[5]]
    left = spark.createDataFrame([tuple(rows[d]) for d, _ in docs], docs_of(spark, SF_SMALL).schema)
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.sample(left).select("doc_id", "mix_copies").collect()}
    docs = [x for x in docs for _ in range(copies[x[0]])]
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).collect()]
    assert brute.ordered(got) == brute.ordered(brute.token_rows(docs, tokenizer))
