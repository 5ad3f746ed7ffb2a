"""Search against brute force, on small fixtures built to be awkward."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from doclake import session
from doclake.functions.terms import query_terms
from doclake.operators import postings, search, viewer
from doclake.operators.fragments import with_search_text
from doclake.sources.index import read_index, read_postings, write_index, write_postings

WORDS = ["the", "then", "other", "a", "aa", "aaa", "ñandú", "de", "la", "dela", "of", "of the", "x y", "the\nof", "é", "the the"]


def small_index(spark, seed=7, count=300):
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        # A third of the fragments are in one document.
        doc = "HOT_DOC" if n % 3 == 0 else f"doc-{n % 17}"
        text = rng.choice([" ", "\n", "  "]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))
        rows.append((f"{doc}-fragment-{n}", doc, doc.replace("-", " ").title(), f"Sec {rng.choice(WORDS)}", n, f"{doc}.md", text, text))
    schema = (
        "id string, document_id string, title string, section string, chunk_number int, source string, "
        "content_markdown string, content_text string"
    )
    return spark.createDataFrame(rows, schema).repartition(4)


REQUESTS = [
    "the", "of the", '"of the"', "de la", "a", "aa", '"the the" a', '"of the" "x y"', "the  THE the", '"the', "ñandú é",
    "", '" " de la', "hen", "he", "zzz", "the zzz", '"zzz"', "sec", '"x y" the', "y", "hot",
]


def request_rows(spark, limits=(10,)):
    rows = [(i, q, limits[i % len(limits)]) for i, q in enumerate(REQUESTS)]
    return spark.createDataFrame(rows, "query_id long, query string, limit int")


def brute_force(fragments, requests, spark):
    parsed = requests.select("query_id", "limit", query_terms(F.col("query")).alias("terms")).collect()
    texts = {r["id"]: (r, f"{r['title']} {r['section']} {r['content_text']}".lower()) for r in fragments.collect()}
    expected = []
    for request in parsed:
        words = [t["text"] for t in request["terms"] if not t["is_phrase"]]
        phrases = [t["text"] for t in request["terms"] if t["is_phrase"]]
        hits = []
        for row, text in texts.values():
            if request["terms"] and all(w in text for w in words):
                score = sum(min(text.count(w), 5) * 10 + 10000 for w in words)
                score += text.count(phrases[0]) * 50000 if phrases else 0
                if score:
                    hits.append((-score, row["chunk_number"], row["document_id"], row["id"]))
        for rank, (score, _, _, found) in enumerate(sorted(hits)[: request["limit"]], start=1):
            expected.append((request["query_id"], rank, found, -score))
    return sorted(expected)


def answers(hits):
    return sorted(tuple(r) for r in hits.select("query_id", "rank", "id", "score").collect())


@pytest.fixture(scope="module")
def indexed(spark):
    fragments = small_index(spark)
    return fragments, with_search_text(fragments.drop("content_markdown")).cache()


def test_batch_search_equals_brute_force(spark, indexed):
    fragments, index = indexed
    requests = request_rows(spark, limits=(10, 3, 100))
    expected = brute_force(fragments, requests, spark)
    assert len(expected) > 100
    assert answers(search.search(index, requests)) == expected


def test_search_without_broadcast_equals_brute_force(spark, indexed, monkeypatch):
    fragments, index = indexed
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = request_rows(spark, limits=(100,))
        found = search.search(index, requests)
        assert answers(found) == brute_force(fragments, requests, spark)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_searches_need_no_vocabulary(spark, indexed, monkeypatch):
    fragments, index = indexed
    requests = request_rows(spark, limits=(100,))
    expected = brute_force(fragments, requests, spark)

    def vocabulary(posted):
        raise AssertionError("a vocabulary was made")

    with monkeypatch.context() as patched:
        patched.setattr(postings, "vocabulary", vocabulary)
        found = search.search(index, requests)
        assert answers(found) == expected
        monkeypatch.setattr(postings, "DIRECT_ANCHORS", 0)
        with pytest.raises(AssertionError, match="a vocabulary was made"):
            search.search(index, requests)
    assert answers(search.search(index, requests)) == expected


def test_stored_postings_equal_brute_force(spark, indexed, tmp_path):
    fragments, _ = indexed
    write_index(fragments, f"{tmp_path}/rows")
    index = read_index(spark, f"{tmp_path}/rows")
    write_postings(index, str(tmp_path), buckets=8, spread=3)
    posted, vocab = read_postings(spark, str(tmp_path))
    requests = request_rows(spark, limits=(100,))
    expected = brute_force(fragments, requests, spark)
    assert answers(search.search_stored(index, requests, posted, vocab)) == expected
    assert answers(search.search(index, requests, vocab)) == expected


PHRASES = [
    '"a a"', '"aa aa"', '"a a a"', '"he the"', '"e t"', '"the the the"', '"hen othe"', '"x y x"', '"ther the"', '"e of"', '"la de la"',
    '"a  aa"', "a aa", "the then other", '"sec the"', '"hot doc"', '"é é"', '"the" the',
]


def test_phrases_equal_brute_force(spark, tmp_path):
    """Phrases over both token borders, with overlaps, line ends and runs of spaces between words."""
    fragments = small_index(spark, seed=11, count=400)
    write_index(fragments, f"{tmp_path}/rows")
    index = read_index(spark, f"{tmp_path}/rows")
    write_postings(index, str(tmp_path), buckets=5, spread=2)
    posted, vocab = read_postings(spark, str(tmp_path))
    asked = [(n, q, 100) for n, q in enumerate(PHRASES)]
    requests = spark.createDataFrame(asked, "query_id long, query string, limit int")
    expected = brute_force(fragments, requests, spark)
    assert len({row[0] for row in expected}) > 10
    assert answers(search.search_stored(index, requests, posted, vocab)) == expected


def test_stored_search_reads_texts_of_hits_only(spark, indexed, tmp_path):
    """Scores come from postings: neither haystack nor token lists are read for them."""
    fragments, _ = indexed
    write_index(fragments, f"{tmp_path}/rows")
    index = read_index(spark, f"{tmp_path}/rows")
    write_postings(index, str(tmp_path), buckets=8, spread=3)
    posted, vocab = read_postings(spark, str(tmp_path))
    requests = request_rows(spark, limits=(10,))
    found = search.search_stored(index, requests, posted, vocab)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "haystack" not in plan and "tokens#" not in plan
    searches = session.stored(search.distinct_searches(search.checked_requests(requests)), "s")
    matches = postings.stored_matches(searches, posted, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "content_text" not in matches and "CartesianProduct" not in matches and "NestedLoop" not in matches


def test_words_with_a_common_opening_meet_few_tokens(spark):
    """Words and tokens that all open alike meet on a rarer run of characters."""
    vocab = spark.range(20_000).select(
        F.concat(F.lit("con"), F.lower(F.conv("id", 10, 36)), F.lit("q")).alias("token"), F.lit(1).cast("long").alias("fragments")
    )
    words = spark.range(500).select(F.concat(F.lit("con"), F.lower(F.conv(F.col("id") * 37 + 1000, 10, 36))).alias("word"))
    found = postings.match_words(words, vocab, True)
    want = {(w, t) for w in (r[0] for r in words.collect()) for t in (r[0] for r in vocab.collect()) if w in t}
    assert {(r["word"], r["token"]) for r in found.collect()} == want
    asked = words.select("word", F.explode(postings.word_grams(F.col("word"))).alias("gram"))
    tokens = vocab.select("token", F.explode(postings.token_grams(F.col("token"), [3])).alias("gram"))
    counts = {r["gram"]: r["n"] for r in tokens.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    grams = {}
    for r in asked.collect():
        grams.setdefault(r["word"], []).append(counts.get(r["gram"], 0))
    assert sum(min(n) for n in grams.values()) < 500 * 200 < sum(max(n) for n in grams.values())


def test_search_one_equals_batch(spark, indexed):
    fragments, index = indexed
    for query in [q for q in REQUESTS if q]:
        one = spark.createDataFrame([(0, query, 7)], "query_id long, query string, limit int")
        expected = [(found, score) for _, _, found, score in brute_force(fragments, one, spark)]
        got = [(r["id"], r["score"]) for r in search.search_one(index, query, 7).collect()]
        assert got == expected, query


def test_search_one_checks_its_arguments(indexed):
    for query, limit in (("", 10), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            search.search_one(indexed[1], query, limit)


def test_copies_of_a_request_are_searched_once(spark, indexed):
    _, index = indexed
    copies = spark.range(60).select(
        F.col("id").alias("query_id"), F.lit(" OF   the").alias("query"), (F.col("id") % 5 + 1).cast("int").alias("limit")
    )
    assert search.distinct_searches(search.checked_requests(copies)).count() == 1
    per_request = search.search(index, copies).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in per_request} == {i: i % 5 + 1 for i in range(60)}


def test_candidates_come_once_per_search_and_fragment(spark, indexed):
    _, index = indexed
    searches = session.stored(search.distinct_searches(search.checked_requests(request_rows(spark))), "s")
    vocab = postings.vocabulary(postings.postings(index))
    found = postings.scan_candidates(index, postings.anchors(searches, vocab)).select("q", "id")
    assert found.count() == found.distinct().count()


def test_hits_are_cut_before_the_shuffle(spark, indexed):
    _, index = indexed
    asked = search.checked_requests(request_rows(spark))
    searches = session.stored(search.distinct_searches(asked), "s")
    vocab = postings.vocabulary(postings.postings(index))
    candidates = postings.scan_candidates(index, postings.anchors(searches, vocab))
    plan = search.top_hits(search.score_candidates(candidates))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning(q") >= 1 and "content_text" not in plan.split("InMemoryTableScan")[0]


def view_rows(spark, fragments, queries=("the", "", '"of the" the', "aa la")):
    docs = [r[0] for r in fragments.select("document_id").distinct().orderBy("document_id").collect()]
    rows = [
        (f"{d}/{i}/{page}", d, q, page, size)
        for d in docs
        for i, q in enumerate(queries)
        for page, size in ((1, 5), (2, 5), (99, 7))
    ]
    return spark.createDataFrame(rows, "request_id string, document_id string, query string, page int, page_size int")


def test_pages_equal_brute_force(spark, indexed):
    fragments, _ = indexed
    requests = view_rows(spark, fragments)
    rows = fragments.collect()
    parsed = requests.withColumn("terms", query_terms(F.col("query"))).collect()
    expected, totals = set(), set()
    for r in parsed:
        found = []
        for f in rows:
            text = f"{f['section']} {f['content_text']}".lower()
            if f["document_id"] != r["document_id"]:
                continue
            if all(t["text"] in text for t in r["terms"] if t["required"]):
                score = 0
                for t in r["terms"]:
                    n = text.count(t["text"])
                    score += n * 50000 if t["is_phrase"] else min(n, 5) * 10 + (10000 if n else 0)
                found.append((-score, f["chunk_number"], f["id"]))
        found.sort()
        pages = max(1, -(-len(found) // r["page_size"]))
        page = min(r["page"], pages)
        totals.add((r["request_id"], page, r["page_size"], len(found), pages))
        first = (page - 1) * r["page_size"]
        for position, (score, _, fid) in enumerate(found[first : first + r["page_size"]], start=first + 1):
            expected.add((r["request_id"], fid, -score, position, page, len(found), pages))
    asked = viewer.check_view_requests(requests)
    scored = viewer.search_fragments(fragments, asked)
    got = viewer.paginate(scored).select("request_id", "id", "score", "position", "page", "total", "total_pages")
    assert {tuple(r) for r in got.collect()} == expected
    assert {tuple(r) for r in viewer.page_totals(scored, asked).collect()} == totals


def test_all_pages_rebuild_the_list_once(spark, indexed):
    fragments, _ = indexed
    total = fragments.where("document_id = 'HOT_DOC'").count()
    pages = spark.range(1, -(-total // 4) + 1).select(
        F.concat(F.lit("p"), "id").alias("request_id"), F.lit("HOT_DOC").alias("document_id"),
        F.lit("").alias("query"), F.col("id").cast("int").alias("page"), F.lit(4).alias("page_size"),
    )
    got = viewer.paginate(viewer.search_fragments(fragments, viewer.check_view_requests(pages)))
    numbers = [r["chunk_number"] for r in got.orderBy("page", "position").collect()]
    assert numbers == sorted(numbers) and len(numbers) == len(set(numbers)) == total


def test_unknown_documents_are_reported(spark, indexed):
    fragments, _ = indexed
    requests = spark.createDataFrame([("r", "none"), ("s", "HOT_DOC")], "request_id string, document_id string")
    assert [r["request_id"] for r in viewer.unknown_documents(fragments, requests).collect()] == ["r"]


def test_page_of_fragment(spark):
    df = spark.createDataFrame([(1,), (5,), (6,), (0,)], "n int")
    assert [r[0] for r in df.select(viewer.page_of_fragment(F.col("n"), F.lit(5))).collect()] == [1, 1, 2, 1]


def test_postings_are_made_without_a_shuffle(spark, indexed):
    """One row per fragment and token, with all of its places, by the task that reads the fragment."""
    _, index = indexed
    made = postings.placed_postings(index)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("a-1", "a", 1, "la de la\nla x")], "id string, document_id string, chunk_number int, haystack string")
    found = {r["token"]: (r["tf"], r["places"]) for r in postings.placed_postings(rows).collect()}
    assert found == {"la": (3, [1, 4, 7]), "de": (1, [3]), "x": (1, [8])}


def test_stored_search_shuffles_a_posting_once(spark, indexed, tmp_path):
    """Pairs of searches and fragments are neither shuffled nor stored, only postings are, once."""
    fragments, _ = indexed
    write_index(fragments, f"{tmp_path}/rows")
    write_postings(read_index(spark, f"{tmp_path}/rows"), str(tmp_path), buckets=8, spread=3)
    posted, vocab = read_postings(spark, str(tmp_path))
    searches = session.stored(search.distinct_searches(search.checked_requests(request_rows(spark))), "s")
    executed = postings.stored_matches(searches, posted, vocab)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(id") == 1 and executed.count("Exchange hashpartitioning") == 1


def test_digests_of_haystacks_are_made_once_per_fragment(spark):
    from doclake.plans.registry import QUERIES

    plan = QUERIES["search_haystacks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5(") > plan.index("Generate explode")
