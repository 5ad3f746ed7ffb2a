"""Top-k search, toxicity, decontamination and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from doclake.llm import decontamination, maxscore, toxicity
from doclake.llm.common import table
from doclake.llm.queries import LLM_ORACLES, LLM_QUERIES


SF_DIR = "/root/testdata/sf0.001"


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 25)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 4)
    rng = random.Random(3)
    rows = [(n, [rng.gauss(0, 0.3) for _ in range(12)]) for n in range(200)]
    rows += [(n, [0.25] * 12) for n in range(200, 260)]  # ties
    rows += [(300, None), (301, [None] * 12), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (None, [0.1] * 12)]
    rows += [(320, []), (340, [1.0, 2.0]), (361, [5.0] * 12), (361, [5.0] * 12), (361, [0.5] * 12), (380, [1e300 * 0 + 1.5] * 12)]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, shard string")
    got = maxscore.search(docs, F.col("vec_id") % 20 == 0, 7).collect()
    fit = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit.append((i, [math.floor(64 * x) for x in v]))
    want = set()
    for q, asked in ((i, v) for i, v in fit if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in fit if i != q)[:7]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert maxscore.search(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = docs.where("vec_id in (20, 21)")
    assert [tuple(r)[:3] for r in maxscore.search(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21)]


def labelled():
    rng = random.Random(6)
    rows = []
    for n in range(600):
        sentences = [" ".join(f"w{rng.randrange(200)}" for _ in range(6)) for _ in range(rng.randint(1, 8))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["vileword", "vilething", "rotten"])
        rows.append((n, ". ".join(sentences) + ".", toxic))
    return rows


def test_toxicity_on_held_out_labels(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (9002, "!!! ...", "x"), (None, "rotten", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model == toxicity.fit(docs.repartition(7), labels)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(scored) == len(rows) + 4
    wrong = 0
    for i, _, y in rows:
        assert scored[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if scored[i]["held_out"]:
            wrong += scored[i]["predicted"] != y
    assert wrong <= 4
    assert all(0 <= r["score"] <= 1 for r in scored.values())
    assert [scored[i]["predicted"] for i in (9000, 9001, 9002, None)] == [0, 0, 0, 1]
    # The sentences that are found hold the offending words, and every toxic document is kept out.
    texts = {i: t for i, t, _ in rows}
    for row in toxicity.offending_sentences(docs.where("doc_id < 600"), model).collect():
        assert re.search("vile|rotten", texts[row["doc_id"]][row["start"] : row["end"]])
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in scored.items() if not r["predicted"]}
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] < 0.01


def brute_template(text):
    unit = r"([0-9] ?)(?i:" + "|".join(sorted(decontamination.UNITS, key=lambda u: (-len(u), u))) + r")(?![^\W_])"
    text = re.sub(unit, lambda m: m.group(1) + "", text)
    text = re.sub(r"(?<=[a-z0-9] )[A-Z][a-z]+|(?<=[a-z0-9][,;] )[A-Z][a-z]+", "", text)
    return re.findall(r"[^\W_]+|(?:[^\W_]|[])+", re.sub("[0-9]+", "0", text).lower())


def test_decontamination(spark):
    asked = "A train leaves Boston at 45 km per hour and Alice counts 12 apples, then Alice sells 12 apples to Bob for 3 kg of sugar today."
    items = [(1, asked), (2, "what is two plus two"), (3, None), (4, ""), (5, asked)]
    other = asked.replace("Boston", "Denver").replace("45 km", "99 miles").replace("Alice", "Carol").replace("12", "7").replace("Bob", "Dave")
    docs = [
        (10, "Intro text here. " + other + " More."),
        (11, "Intro. " + other.replace("then Carol", "then Erin") + " More."),  # one name stands for two
        (12, "xx yy zz a WHAT is two, plus two? b"),
        (13, None), (14, ""), (15, "what is two plus three"), (None, asked), (16, asked.upper()),
        (17, " ".join(asked.split()[:8])), (18, "word " * 20_000 + asked), (18, "word " * 20_000 + asked),
    ]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, words string").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = decontamination.matches(docs, bench)
    got = {(r["doc_id"], r["item_id"], r["run_words"], r["verbatim"]) for r in found.collect()}
    both = {(i, n, 27, same) for i, same in ((10, False), (None, True), (18, True)) for n in (1, 5)}
    assert got == both | {(12, 2, 5, True)}
    assert found.count() == len(got)
    left = [r["doc_id"] for r in decontamination.clean(docs, bench).collect()]
    assert sorted(left) == [11, 13, 14, 15, 16, 17]
    assert decontamination.matches(docs.limit(0), bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).count() == 0
    words = docs.select("text", decontamination.template(F.col("text")).alias("w")).where("text is not null").collect()
    assert all(r["w"] == brute_template(r["text"]) for r in words)


def test_verbatim_runs_are_found(spark):
    """Few plain words, or slots elsewhere in the run that do not fit, never hide a copy."""
    head = "when 12 boxes hold red pens and blue pens and green pens"
    tail = "then 12 of them are sold each day until none of the pens is left"
    first = "ann has 3 cats and 3 dogs and 3 birds in one small old house"
    second = "later 5 men come with 5 more of them for a new garden there"
    items = [(1, "What is 12 times 34 plus 5?"), (2, "71 + 82"), (3, "sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14 please and say why it is so"), (4, f"{head} {tail}")]
    items += [(5, f"{first} red {second}")]
    docs = [
        (10, "Xx. What is 12 times 34 plus 5? yy"), (11, "xx what IS 12 times 34 plus 5"), (12, "What is 12 times 34 plus 6?"),
        (20, "a 71 82 b"), (21, "a 71 93 b"), (30, "q w 1 2 3 4 5 6 7 8 9 10 11 12 13 e r"), (31, "q w 1 2 3 4 5 6 7 8 9 10 11 13 12 e r"),
        (40, f"{head.replace('12', '9')} {tail}"),  # 12 stands for two numbers, the tail is a copy
        (41, f"{head.replace('12', '9').replace('red', 'pink')} {tail.replace('sold', 'lent')}"),
        (42, f"{head.replace('boxes', 'crates').replace('red', 'pink')} {tail.replace('12', '9')}"),
        (50, f"{first.replace('3 c', '4 c').replace('3 d', '7 d')} blue {second.replace('5', '6')}"),
    ]
    found = decontamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {(r["doc_id"], r["item_id"], r["run_words"], r["verbatim"]) for r in found.collect()}
    assert got == {(10, 1, 7, True), (11, 1, 7, True), (20, 2, 2, True), (30, 3, 13, True), (40, 4, 25, True), (42, 4, 22, False), (50, 5, 14, False)}


def test_planted_passages_are_found(spark):
    """A run of 13 words of a question anywhere in a document, whatever lies around it."""
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"q{rng.randrange(10**9):x}" for _ in range(n))
    items = [(n, fresh(40)) for n in range(20)]
    docs = [(n, f"{fresh(n)} {' '.join(items[n % 20][1].split()[n % 7 : n % 7 + 13])} {fresh(5)}") for n in range(60)]
    docs += [(100 + n, fresh(200)) for n in range(40)]
    found = decontamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(n, n % 20) for n in range(60)}


@pytest.mark.parametrize("name", ["op3_secret_scan", "op4_decontamination"])
def test_native_operators_run_no_python(spark, name):
    plan = LLM_QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, SF_DIR)
    cursor = con.execute(LLM_ORACLES[name])
    found = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(found) == columns
    want = [tuple(row[found.index(c)] for c in columns) for row in cursor.fetchall()]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)


def test_pipeline_keeps_columns_and_clean_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema == docs.schema, name
        assert 0.7 * docs.count() < out.count() <= docs.count()
        docs = out
    assert docs.where("not round_trip").count() == 0
    empty = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
