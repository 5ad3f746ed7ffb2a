"""Files and streams: round trips, bad input, restarts."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from doclake import schemas, session
from doclake.operators import pages, fragments
from doclake.sources import client_errors, files, markdown
from doclake.sources import fragments as fragment_store
from doclake.sources import index as index_store
from doclake.streaming import ingest as streaming

BODIES = {
    "ORD_1": "# Uno\ntexto de la ordenanza\n## Dos\notro",
    "RES-2": "\n\n## Página 1\n\n" + "párrafo largo " * 200,
    "blank": "\n\n",
}


def write_files(folder, bodies):
    for name, body in bodies.items():
        (folder / f"{name}.md").write_text(body, encoding="utf-8")


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "markdown"
    path.mkdir()
    write_files(path, BODIES)
    (path / "note.txt").write_text("no Markdown")
    return path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read_markdown(spark, folder):
    got = {r["document_id"]: (r["file_name"], r["markdown"]) for r in markdown.read_markdown(spark, str(folder)).collect()}
    assert got == {name: (f"{name}.md", body) for name, body in BODIES.items()}


def test_markdown_table(spark, folder, tmp_path):
    docs = markdown.read_markdown(spark, str(folder))
    markdown.write_markdown(docs, f"{tmp_path}/table")
    assert rows(markdown.read_markdown_table(spark, f"{tmp_path}/table")) == rows(docs)


def test_list_library(spark, folder):
    (folder / "a.PDF").write_bytes(b"123")
    got = [(r["file_name"], r["stem"], r["suffix"], r["size_bytes"]) for r in files.list_library(spark, str(folder)).collect()]
    assert got == [("a.PDF", "a", ".pdf", 3)]
    listing = files.list_files(spark, str(folder))
    assert listing.count() == 5
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_fragment_json_with_a_bad_file(spark, folder, tmp_path):
    wanted = fragments.fragments_from_markdown(markdown.read_markdown(spark, str(folder)))
    out = tmp_path / "json"
    out.mkdir()
    by_doc = {}
    for r in wanted.collect():
        by_doc.setdefault(r["document_id"], []).append(r.asDict())
    for name, items in by_doc.items():
        (out / f"{name}.json").write_text(json.dumps(items, ensure_ascii=False, indent=2), encoding="utf-8")
    (out / "broken.json").write_text('[{"id": "x", ')
    good, bad = fragment_store.read_fragments(spark, str(out))
    assert rows(good) == rows(wanted)
    assert [r["file_path"].rsplit("/", 1)[1] for r in bad.collect()] == ["broken.json"]


def test_fragment_table_and_json_lines(spark, folder, tmp_path):
    wanted = fragments.fragments_from_markdown(markdown.read_markdown(spark, str(folder)))
    fragment_store.write_fragments(wanted, f"{tmp_path}/t")
    assert rows(fragment_store.read_fragment_table(spark, f"{tmp_path}/t")) == rows(wanted)
    fragment_store.write_fragments_json(wanted, f"{tmp_path}/j")
    for good, bad in (
        fragment_store.read_fragments(spark, f"{tmp_path}/j"),
        fragment_store.read_fragment_lines(spark, f"{tmp_path}/j"),
    ):
        assert rows(good) == rows(wanted)
        assert good.count() == wanted.count() and bad.count() == 0


def test_no_record_of_a_json_file_is_lost(spark, tmp_path):
    record = '{"id": "%s", "document_id": "d"}'
    (tmp_path / "lines.json").write_text("\n".join([record % "a", record % "b", "{broken", record % "c"]))
    (tmp_path / "pretty.json").write_text("[\n" + ",\n".join([record % "e", record % "f"]) + "\n]\n")
    (tmp_path / "cut.json").write_text("[" + record % "g" + ", ")
    good, bad = fragment_store.read_fragments(spark, str(tmp_path))
    assert sorted(r["id"] for r in good.collect()) == ["a", "b", "c", "e", "f"]
    assert good.count() == 5 and bad.count() == 2
    assert sorted(r["file_path"].rsplit("/", 1)[1] for r in bad.collect()) == ["cut.json", "lines.json"]


def test_store_without_a_batch_is_empty(spark, tmp_path):
    from doclake.streaming import ingest as streaming

    empty = streaming.read_store(spark, f"{tmp_path}/none")
    assert empty.count() == 0 and empty.columns == schemas.FRAGMENT.fieldNames()


def test_uploaded_pages_replace_their_document(spark, tmp_path):
    def upload(rows, number, files=1):
        numbered = spark.createDataFrame([(*r, number) for r in rows], schemas.PAGE_UPLOAD)
        numbered.repartition(files).write.mode("append").parquet(f"{tmp_path}/pages")
        stream = streaming.stream_pages_table(spark, f"{tmp_path}/pages", max_files=1)
        streaming.stream_ingest_pages(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
        return sorted((r["id"], r["content_text"][-5:]) for r in streaming.read_store(spark, f"{tmp_path}/store").collect())

    first = upload([("a", 1, "one a", 0), ("a", 2, "two a", 0), ("b", 1, "one b", 0), ("b", None, "lost", 0)], None)
    assert [i for i, _ in first] == ["a-fragment-2", "a-fragment-3", "b-fragment-2"]
    second = upload([("a", 1, "new a", 0)], 1)
    assert second == [("a-fragment-2", "new a"), ("b-fragment-2", "one b")]
    # Pages of the same upload that come later join it, page by page and in any order.
    third = upload([("a", 4, "4th a", 0), ("a", 3, "3rd a", 0), ("a", 2, "2nd a", 0)], 1, files=3)
    assert third == [(f"a-fragment-{n + 1}", x) for n, x in ((1, "new a"), (2, "2nd a"), (3, "3rd a"), (4, "4th a"))] + [("b-fragment-2", "one b")]
    # A page that is sent again replaces itself; one of an upload that was replaced changes nothing.
    assert upload([("a", 2, "2ND a", 0)], 1)[1] == ("a-fragment-3", "2ND a")
    assert upload([("a", 9, "late a", 0)], 0) == upload([], 1) and len(upload([], 1)) == 5
    assert spark.read.parquet(f"{tmp_path}/store/errors").count() == 1


def test_pages_of_a_document_in_many_batches(spark, tmp_path):
    """One file per trigger and every page in a file of its own: nothing is lost."""
    rows_in = [("d", n, f"# Title {n}\n\nbody {n}", 0) for n in range(1, 8)] + [("e", n, f"text {n}", 0) for n in (5, 2)]
    spark.createDataFrame(rows_in, schemas.PAGE_TEXT).repartition(9).write.parquet(f"{tmp_path}/pages")
    before = set(_shared_names(spark))
    stream = streaming.stream_pages_table(spark, f"{tmp_path}/pages", max_files=1)
    streaming.stream_ingest_pages(stream, f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    want = fragments.fragments_from_pages(spark.createDataFrame(rows_in, schemas.PAGE_TEXT))
    assert rows(streaming.read_store(spark, f"{tmp_path}/store")) == rows(want)
    # What the batches stored on their way is gone again.
    assert not [n for n in set(_shared_names(spark)) - before if n.startswith(("touched", "batch"))]


def _shared_names(spark):
    import os

    return os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))


def test_repeated_pages_and_bodies_get_ids_of_their_own(spark):
    rows_in = [("d", 1, "one", 0), ("d", 2, "two", 0), ("d", 2, "two", 0), ("d", 2, "# other\n\n# heads", 0), ("d", 3, "three", 0)]
    pages_in = spark.createDataFrame(rows_in, schemas.PAGE_TEXT).repartition(3)
    found = rows(fragments.fragments_from_pages(pages_in))
    assert found == rows(fragments.fragments_from_markdown(pages.assemble_pages(pages_in)))
    assert len({r[0] for r in found}) == len(found) >= 6
    docs = spark.createDataFrame([("x", "x.md", "# a"), ("x", "x.md", "# b"), ("y", "y.md", "# c")], schemas.MARKDOWN)
    assert rows(fragments.repeated_bodies(docs)) == [("x", "error", "Documento repetido: 2")]
    assert rows(fragments.one_body(docs)) == [("x", "x.md", "# b"), ("y", "y.md", "# c")]


def test_index_forms_and_refresh(spark, folder, tmp_path):
    wanted = fragments.fragments_from_markdown(markdown.read_markdown(spark, str(folder)))
    index_store.write_index(wanted, f"{tmp_path}/i")
    index_store.write_index(wanted.where("document_id = 'ORD_1'"), f"{tmp_path}/i")
    stored = index_store.read_index(spark, f"{tmp_path}/i")
    assert {r["document_id"] for r in stored.collect()} == {"ORD_1"}
    index_store.write_index_json(wanted, f"{tmp_path}/j")
    assert rows(index_store.read_index_json(spark, f"{tmp_path}/j")) == rows(fragments.search_index(wanted))


def test_filter_on_document_reaches_the_scan(spark, folder, tmp_path):
    wanted = fragments.fragments_from_markdown(markdown.read_markdown(spark, str(folder)))
    fragment_store.write_fragments(wanted, f"{tmp_path}/t")
    table = fragment_store.read_fragment_table(spark, f"{tmp_path}/t")
    plan = table.where("document_id = 'ORD_1'").select("section")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(document_id,ORD_1)" in plan
    assert "ReadSchema: struct<document_id:string,section:string>" in plan
    with pytest.raises(LookupError):
        fragments.documents_fragments(table, "nobody")
    assert fragments.documents_fragments(table, "ORD_1").count() == 2


def start(spark, folder, base):
    docs = streaming.stream_markdown(spark, str(folder), max_files=1)
    streaming.stream_ingest(docs, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return streaming.read_store(spark, f"{base}/store")


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    write_files(path, {"ORD_1": BODIES["ORD_1"], "blank": BODIES["blank"]})
    start(spark, path, tmp_path)
    write_files(path, {"RES-2": BODIES["RES-2"]})
    stored = start(spark, path, tmp_path)
    wanted = fragments.fragments_from_markdown(markdown.read_markdown(spark, str(path)))
    assert rows(stored) == rows(wanted)
    assert rows(start(spark, path, tmp_path)) == rows(wanted)
    streaming.compact_store(spark, f"{tmp_path}/store", f"{tmp_path}/compact")
    assert rows(fragment_store.read_fragment_table(spark, f"{tmp_path}/compact")) == rows(wanted)


def test_stream_replaces_a_document_that_comes_again(spark, tmp_path):
    table = f"{tmp_path}/table"

    def add(body):
        new = spark.createDataFrame([("ORD_1", "ORD_1.md", body)], schemas.MARKDOWN)
        new.write.mode("append").parquet(table)
        docs = streaming.stream_markdown_table(spark, table)
        streaming.stream_ingest(docs, f"{tmp_path}/store", f"{tmp_path}/checkpoint").awaitTermination()
        return {r["section"] for r in streaming.read_store(spark, f"{tmp_path}/store").collect()}

    assert add("# A\nx\n# B\ny") == {"A", "B"}
    assert add("# C\nz") == {"C"}
    assert add("\n") == set()


def test_newest_body_of_a_batch_wins(spark):
    docs = spark.createDataFrame(
        [("a", "a.md", "old", 1), ("a", "a.md", "new", 2), ("b", "b.md", "only", 1)],
        "document_id string, file_name string, markdown string, t int",
    ).withColumn("modified_at", F.timestamp_seconds("t"))
    assert rows(streaming.newest_bodies(docs)) == [("a", "a.md", "new"), ("b", "b.md", "only")]


def test_client_errors_batch_and_stream(spark, tmp_path):
    reports = spark.createDataFrame([("m", "s", 1, 2, "st"), (None, None, None, None, None)], schemas.CLIENT_ERROR)
    client_errors.append_client_errors(reports, f"{tmp_path}/e")
    client_errors.append_client_errors(reports, f"{tmp_path}/e")
    stored = spark.read.parquet(f"{tmp_path}/e")
    assert stored.count() == 4 and stored.columns == client_errors.COLUMNS
    assert stored.where("timestamp > 1.6e9").count() == 4
    reports.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(schemas.CLIENT_ERROR).parquet(f"{tmp_path}/in")
        streaming.stream_client_errors(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


class UnsetSession:
    """A session without the setting, as far as the shared folder is concerned."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")


def test_shared_folder_without_the_setting():
    local = UnsetSession("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    with pytest.raises(ValueError):
        session.shared_dir(UnsetSession("yarn"))


def test_shared_folder_comes_from_the_session(spark):
    assert session.new_shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.new_shared_path(spark, "x") != session.new_shared_path(spark, "x")


def test_pages_of_a_stream_stay_in_the_tasks_that_read_them(spark, tmp_path):
    """As many files per part as tasks, not one file per part."""
    from doclake.plans import registry
    from doclake.plans.views import Views

    pages = spark.range(0, 80, 1, 8).selectExpr("cast(id as string) as document_id", "1 as page_no", "'t' as page_text", "0 as drawings", "id % 2 as part")
    stream = registry._pages_in_parts(Views(spark, ""), pages, str(tmp_path / "pages"), 2)
    written = spark.read.parquet(str(tmp_path / "pages"))
    assert stream.isStreaming and len(written.inputFiles()) == 16 and written.count() == 80


def test_streamed_pages_stay_in_the_tasks_that_read_them(spark, tmp_path, monkeypatch):
    from doclake.plans import registry

    text = F.concat(F.lit("# A\n\ntext "), F.col("id").cast("string"))
    docs = spark.range(0, 60, 1, 6).select(
        F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.length(text).cast("long").alias("n_chars"),
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registry, "new_shared_path", lambda spark, name: f"{tmp_path}/{name}")
    found = registry.QUERIES["stream_ingest_pages"](spark, str(tmp_path)).select("id", "content_text").collect()
    assert len(spark.read.parquet(f"{tmp_path}/ingest/pages").inputFiles()) > 3
    expected = registry.QUERIES["fragments_of_pages"](spark, str(tmp_path)).select("id", "content_text").collect()
    assert sorted(found) == sorted(expected)
    # The page without a number and the others of its row are errors, none is lost.
    errors = spark.read.parquet(f"{tmp_path}/ingest/store/errors")
    assert errors.count() == registry.Views(spark, str(tmp_path)).page_texts().where("document_id is null or page_no is null").count() > 0
