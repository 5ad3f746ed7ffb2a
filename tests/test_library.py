"""Pages, fragments, quality, catalog, duplicates and ingest on small fixtures."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from doclake import schemas, session
from doclake.functions import chunking, noise
from doclake.operators import catalog, dedup, fragments, ingest, pages, present, quality
from doclake.operators.ranking import with_position

ALPHABET = ["word", "# ", "## T", "\n", "\n\n", "\r\n", " ", "x" * 150, "*", "`", "-", "\x0c", " ", " ", "#######"]


def random_text(rng, size):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size)))


def page_rows(spark, seed=3, docs=6, hot_pages=200):
    """Documents with shuffled pages; one of them has most of the pages."""
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        for n in range(1, (hot_pages if d == 0 else rng.randint(1, 9)) + 1):
            text = rng.choice(["", "  ", random_text(rng, 60)])
            rows.append((f"doc_{d}", n, text, rng.randint(0, 10)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, schemas.PAGE_TEXT).repartition(3)


def test_pages_cut_one_by_one_equal_the_assembled_document(spark):
    table = page_rows(spark)
    whole = fragments.fragments_from_markdown(pages.assemble_pages(table))
    apart = fragments.fragments_from_pages(table)
    left, right = ({tuple(r) for r in df.collect()} for df in (whole, apart))
    assert left == right and len(left) > 200


def test_long_document_has_one_body_and_unique_ids(spark):
    rows = [("long", n, f"text of page {n}", 0) for n in range(1, 3001)]
    rng = random.Random(3)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, schemas.PAGE_TEXT)
    bodies = pages.assemble_pages(table).collect()
    assert len(bodies) == 1
    assert [int(n) for n in re.findall(r"## Página (\d+)", bodies[0]["markdown"])] == list(range(1, 3001))
    ids = [r["id"] for r in fragments.fragments_from_pages(table).select("id").collect()]
    assert len(ids) == len(set(ids)) == 3000


def test_pages_without_a_place_become_error_rows(spark):
    rows = [("d", 1, "a", 0), ("d", None, "b", 0), (None, 1, "c", 0), (None, None, "d", 0)]
    table = spark.createDataFrame(rows, schemas.PAGE_TEXT)
    errors = {tuple(r) for r in pages.page_errors(table).collect()}
    assert errors == {("d", "error", "Página sin número"), ("", "error", "Página sin documento")}
    assert pages.page_errors(table).count() == 3
    assert [r["id"] for r in fragments.fragments_from_pages(table).collect()] == ["d-fragment-2"]


def test_upsert_keeps_one_row_per_key(spark):
    from doclake.operators import ingest

    current = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int")
    incoming = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "id string, n int")
    assert sorted(map(tuple, ingest.upsert(current, incoming).collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_assembled_page_text(spark):
    rows = [("d", 2, "", 0), ("d", 1, "text", 0)]
    got = pages.assemble_pages(spark.createDataFrame(rows, schemas.PAGE_TEXT)).first()
    assert got["markdown"] == (
        "\n\n## Página 1\n\ntext\n\n## Página 2\n\n*[Página sin texto legible extraíble]*\n"
    )


def test_vector_heavy_looks_at_the_first_pages(spark):
    rows = [("a", 10, "", 150), ("b", 10, "", 151), ("c", 11, "", 151), ("c", 1, "", None)]
    got = pages.vector_heavy(spark.createDataFrame(rows, schemas.PAGE_TEXT)).collect()
    assert {tuple(r) for r in got} == {("a", False), ("b", True), ("c", False)}


def test_select_extraction(spark):
    long_text, fallback = "w" * 150, "f" * 301
    rows = [
        ("keep", long_text, fallback),
        ("short", "w" * 149, fallback),
        ("no fallback", "w" * 149, "f" * 300),
        ("headers", "# " + "h" * 500, fallback),
        ("markers", "==> picture intentionally omitted <==" * 50, fallback),
        ("heavy", long_text, fallback),
        ("heavy, no fallback", long_text, " "),
        ("none", None, None),
    ]
    table = spark.createDataFrame(rows, "document_id string, structured string, fallback string")
    heavy = spark.createDataFrame([(r[0], r[0].startswith("heavy")) for r in rows[1:]], "document_id string, is_vector_heavy boolean")
    got = {r["document_id"]: (r["used_fallback"], r["markdown"]) for r in pages.select_extraction(table, heavy).collect()}
    assert got == {
        "keep": (False, long_text),
        "short": (True, fallback),
        "no fallback": (False, "w" * 149),
        "headers": (True, fallback),
        "markers": (True, fallback),
        "heavy": (True, fallback),
        "heavy, no fallback": (False, ""),
        "none": (False, ""),
    }


def test_packing_loses_nothing_and_keeps_the_limit(spark):
    rng = random.Random(11)
    texts = [random_text(rng, 200) for _ in range(150)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    sections = chunking.sections(F.col("m"))
    row = table.select("i", sections.alias("s"), chunking.pieces(sections, 400).alias("p")).collect()
    cut = 0
    for r in row:
        assert "".join("".join(p["content"].split()) for p in r["p"]) == "".join("".join(s["content"].split()) for s in r["s"])
        for p in r["p"]:
            assert len(p["content"]) <= 400 + 1 or "\n" not in p["content"] or len(p["content"]) <= 400 + p["content"].count("\n") + 2
        cut += len(r["p"]) > len(r["s"])
    assert cut > 30


def test_document_noise_equals_the_text_put_together(spark):
    rng = random.Random(5)
    parts = ["", " ", "----", "-", "=", "ab", "palabra ", "x1y", "|||||", "\n", "abc def "]
    rows = []
    for d in range(300):
        for _ in range(rng.randint(1, 6)):
            rows.append((f"d{d}", "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))))
    table = spark.createDataFrame(rows, "document_id string, content_text string").repartition(4)
    whole = table.groupBy("document_id").agg(F.concat_ws("", F.collect_list(F.concat(F.lit(" "), "content_text"))).alias("t"))
    expected = {r[0]: r[1] for r in whole.select("document_id", noise.is_text_noisy(F.col("t"))).collect()}
    got = {r["document_id"]: r["is_noisy"] for r in quality.document_noise(table).collect()}
    assert got == expected and {True, False} == set(got.values())
    assert {r[0] for r in quality.scanned_documents(table).collect()} == {d for d, bad in expected.items() if bad}


def test_positions_in_blocks_equal_one_window(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int, n int").withColumn("b", F.floor(F.col("n") / 16))
    got = with_position(df, ["g"], ["a", "b"], ["n"]).collect()
    expected = {}
    for g in {r[0] for r in rows}:
        ordered = sorted((a, n) for gg, a, n in rows if gg == g)
        expected |= {(g, n): (i, len(ordered)) for i, (_, n) in enumerate(ordered, start=1)}
    assert {(r["g"], r["n"]): (r["position"], r["group_total"]) for r in got} == expected


def library(spark, names):
    return spark.createDataFrame([(f"uploads/{n}", n, 1000) for n in names], schemas.LIBRARY_FILE)


def test_catalog(spark):
    files = library(spark, ["ORD_1.pdf", "x-y.docx", "0" * 32 + "_acta concejo.pdf", "_.pdf"])
    stems = spark.createDataFrame([("ORD_1",), ("ORD_1",), ("other",)], "id string")
    scanned = spark.createDataFrame([("x-y",), ("x-y",)], "document_id string")
    rows = catalog.with_status_tag(catalog.by_title(catalog.catalog(files, stems, scanned))).collect()
    assert [(r["id"], r["title"], r["original_filename"], r["category"], r["status_tag"]) for r in rows] == [
        ("0" * 32 + "_acta concejo", "Acta Concejo", "acta concejo.pdf", "Resoluciones de Concejo", "Pendiente"),
        ("_", "Documento", "_.pdf", "Resoluciones de Alcaldía", "Pendiente"),
        ("ORD_1", "Ord 1", "ORD_1.pdf", "Ordenanzas", "Markdown"),
        ("x-y", "X Y", "x-y.docx", "Resoluciones de Alcaldía", "PDF Original"),
    ]
    counts = {r[0]: r[1] for r in catalog.category_counts(catalog.catalog(files, stems, scanned).where("id = '_'")).collect()}
    assert counts == {"Ordenanzas": 0, "Resoluciones de Concejo": 0, "Resoluciones de Alcaldía": 1}
    table = catalog.catalog(files, stems, scanned)
    assert [r["id"] for r in catalog.search_titles(table, "ACTA c").collect()] == ["0" * 32 + "_acta concejo"]
    assert [r["id"] for r in catalog.filter_category(table, "Ordenanzas", "  ").collect()] == ["ORD_1"]


def test_duplicates_keep_one_file_per_key(spark):
    names = ["a b.pdf", "a_b.pdf.pdf", "A-B.PDF", "a-b.docx", "single.pdf", "aa.pdf", "aa.doc"]
    files = library(spark, names)
    decided = dedup.duplicate_files(files).collect()
    kept = {r["duplicate_key"]: r["file_name"] for r in decided if r["decision"] == "keep"}
    assert kept == {"a_b": "a b.pdf", "aa": "aa.doc"}
    assert {r["file_name"] for r in decided} == set(names) - {"single.pdf"}
    assert tuple(dedup.duplicate_summary(files).first()) == (2, 4)
    plan = {tuple(r) for r in dedup.delete_plan(files).collect()}
    assert ("aa", "uploads/aa.pdf") in plan and ("aa", "markdown/aa.md") in plan and len(plan) == 12
    texts = spark.createDataFrame([("aa", 1), ("single", 2)], "document_id string, n int")
    assert [r["n"] for r in dedup.purge(texts, dedup.delete_plan(files)).collect()] == [2]


def test_a_group_of_copies_is_never_sorted_or_collected(spark):
    files = spark.range(3000).select(
        F.concat(F.lit("uploads/"), F.col("id"), F.lit("/a.pdf")).alias("key"),
        F.when(F.col("id") % 3 == 0, "same.pdf").otherwise(F.concat("id", F.lit(".pdf"))).alias("file_name"),
        F.col("id").alias("size_bytes"),
    )
    plan = dedup.duplicate_groups(files)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan and "collect" not in plan
    row = dedup.duplicate_groups(files).first()
    assert (row["duplicate_key"], row["n_files"], row["keep_key"]) == ("same", 1000, "uploads/0/a.pdf")


def test_pending_and_plan(spark):
    files = library(spark, ["Ación 1.pdf", "b.doc", "c.txt", "d.PDF"])
    stored = spark.createDataFrame([("b.doc",), ("b.doc",), ("",)], "file_name string")
    assert {r["clean_name"] for r in ingest.pending_files(files, stored).collect()} == {"Acion_1.pdf", "d.PDF"}
    markdown = spark.createDataFrame([("b",), ("d",)], "id string")
    json = spark.createDataFrame([("b",), ("Acion_1",)], "id string")
    assert {r["id"] for r in ingest.pending_outputs(files, markdown, json).collect()} == {"Acion_1", "d"}
    assert [r["error"] for r in ingest.rejected_files(files).collect()] == ["Formato no soportado: .txt"]
    limit = 2 * 1024 * 1024
    sized = spark.createDataFrame(
        [("x1", "big.pdf", limit + 1), ("x2", "two.pdf", limit), ("x3", "big.doc", limit * 9), ("x4", "have.pdf", limit * 9)],
        schemas.LIBRARY_FILE,
    )
    planned = ingest.plan_actions(
        ingest.union_sources({"RES": sized, "ORD": sized.where("file_name = 'have.pdf'")}),
        spark.createDataFrame([("RES_have.pdf",)], "file_name string"),
    )
    assert {(r["target_name"], r["action"]) for r in planned.collect()} == {
        ("RES_big.pdf", "compress"), ("RES_two.pdf", "copy"), ("RES_big.doc", "copy"), ("RES_have.pdf", "skip"),
        ("ORD_have.pdf", "compress"),
    }


def test_reports(spark):
    runs = spark.createDataFrame(
        [("a", "success", 1.5, 4, None), ("b", "error", 0.5, None, "bad"), ("c", "success", 1.0, 3, None)], schemas.RUN_RESULT
    )
    assert tuple(ingest.run_summary(runs).first()) == (2, 1, 7, 3.0)
    copies = spark.createDataFrame(
        [("a", "compressed", 100, 40), ("b", "copied", 10, None), ("c", "timeout", 20, None), ("d", "error", 5, None),
         ("e", "skipped", 50, 30)],
        schemas.COPY_RESULT,
    )
    assert tuple(ingest.copy_report(copies).first()) == (1, 2, 1, 1, 1, 100)
    assert {r["filename"]: r["saved_percent"] for r in ingest.with_saving(copies).collect()}["a"] == 60.0


def test_document_markdown(spark):
    docs = spark.createDataFrame([("a", "# A")], "document_id string, markdown string")
    assert catalog.document_markdown(docs, "a") == "# A"
    with pytest.raises(LookupError):
        catalog.document_markdown(docs, "b")


def test_upsert_and_replace(spark):
    current = spark.createDataFrame([("a-1", "a", 1), ("a-2", "a", 1), ("b-1", "b", 1), ("c-1", "c", 1)], "id string, document_id string, v int")
    incoming = spark.createDataFrame([("a-1", "a", 2), ("d-1", "d", 2)], "id string, document_id string, v int")
    assert {tuple(r) for r in ingest.upsert(current, incoming).collect()} == {
        ("a-1", "a", 2), ("a-2", "a", 1), ("b-1", "b", 1), ("c-1", "c", 1), ("d-1", "d", 2),
    }
    read = spark.createDataFrame([("a",), ("c",), ("d",)], "document_id string")
    assert {r["id"] for r in ingest.replace_documents(current, incoming, read).collect()} == {"a-1", "b-1", "d-1"}
    assert {r["id"] for r in ingest.replace_documents(current, incoming).collect()} == {"a-1", "b-1", "c-1", "d-1"}


def test_metadata_takes_the_first_of_several_files(spark):
    hits = spark.createDataFrame([("a", "T", "a.md"), ("z", "", None)], "document_id string, title string, source string")
    table = spark.createDataFrame([("a", "B", "b.pdf"), ("a", "A", "z.pdf")], "id string, title string, original_filename string")
    got = {r["document_id"]: (r["display_title"], r["display_file"]) for r in present.with_metadata(hits, table).collect()}
    assert got == {"a": ("A", "z.pdf"), "z": ("z", "")}


def test_hot_key_of_a_lookup_is_split(spark, monkeypatch):
    """A key with a third of the rows must not be one task when the lookup is too big to broadcast."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
            F.col("id").alias("n"),
        )
        lookup = spark.range(2000).select(F.col("id").cast("string").alias("id")).union(spark.sql("select 'hot' as id"))
        flagged = catalog.with_flags(rows, "id", known=lookup, other=lookup.limit(1))
        assert flagged.where("known").count() == 20000 + rows.where("id <> 'hot' and n < 2000").count()
        flagged.collect()
        assert "skew=true" in flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_only_name_cleaning_leaves_the_jvm(spark):
    table = page_rows(spark, hot_pages=3)
    plan = fragments.search_index(fragments.fragments_from_pages(table))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # The pages were cut before, once: neither their texts nor a cut of them is in the plan.
    assert "page_text" not in plan and "REPARTITION_BY_COL" not in plan


def test_broadcast_measures_nested_columns(spark):
    """Two thousand rows with 100 kB of text inside a struct are 200 MB, not 2,000 rows."""
    from doclake.session import fits_broadcast

    big = F.repeat(F.lit("x"), 100_000)
    nested = [
        F.struct(big.alias("text")),
        F.array(F.struct(big.alias("text"))),
        F.create_map(F.lit("k"), big),
        F.array(F.array(big)),
    ]
    for column in nested:
        assert not fits_broadcast(spark.range(2000).select(column.alias("entry")))
    small = spark.range(10).select(
        F.struct(F.lit("a").alias("text")).alias("s"), F.array(F.lit(1)).alias("a"), F.lit(None).alias("n")
    )
    assert fits_broadcast(small)
    assert fits_broadcast(small.where("false"))
    assert not fits_broadcast(spark.range(3).select(F.sequence(F.lit(1), F.lit(400_000)).alias("many")))
    assert not fits_broadcast(spark.range(1).select(F.parse_json(F.lit("1")).alias("v")))
