"""The registered queries: each runs operators over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions import names
from doclake.functions.terms import highlight_terms, query_terms
from doclake.functions.text import plain_text
from doclake.operators import catalog as cat
from doclake.operators import dedup, fragments, ingest, pages, present, quality, search, viewer
from doclake.plans.views import Views
from doclake.session import new_shared_path, stored
from doclake.sources import client_errors as errors
from doclake.sources import fragments as fragment_store
from doclake.sources import index as index_store
from doclake.sources import markdown as markdown_store
from doclake.sources import segments
from doclake.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    return build


# --- shared steps ---------------------------------------------------------


def _page_docs(v: Views) -> DataFrame:
    return pages.assemble_pages(v.page_texts())


def _all_docs(v: Views) -> DataFrame:
    return _page_docs(v).unionByName(v.markup_docs())


def _page_fragments(v: Views) -> DataFrame:
    return fragments.fragments_from_pages(v.page_texts())


def _stored_fragments(v: Views) -> DataFrame:
    return stored(_page_fragments(v), "fragments")


def _index(v: Views) -> DataFrame:
    return fragments.search_index(_page_fragments(v))


def _stored_index(v: Views) -> DataFrame:
    path = new_shared_path(v.spark, "index")
    index_store.write_index(_page_fragments(v), path)
    return index_store.read_index(v.spark, path)


def _library(v: Views) -> DataFrame:
    return v.library_files()


def _library_texts(v: Views) -> DataFrame:
    return v.library_texts().select(
        names.stem(F.col("file_name")).alias("document_id"), F.col("text").alias("content_text")
    )


def _markdown_stems(v: Views) -> DataFrame:
    return _library(v).where("size_bytes % 3000 <> 0").select(names.stem(F.col("file_name")).alias("id"))


def _json_stems(v: Views) -> DataFrame:
    return _library(v).where("size_bytes % 5000 <> 0").select(
        names.stem(names.sanitize_filename(F.col("file_name"))).alias("id")
    )


def _stored_names(v: Views) -> DataFrame:
    return _library(v).where("size_bytes % 7000 = 0").select(
        names.sanitize_filename(F.col("file_name")).alias("file_name")
    )


def _catalog(v: Views) -> DataFrame:
    return cat.catalog(_library(v), _markdown_stems(v), quality.scanned_documents(_library_texts(v)))


def _hits(v: Views) -> DataFrame:
    return search.search(_stored_index(v), v.search_requests())


def _exploded_terms(requests: DataFrame, terms) -> DataFrame:
    return requests.select("query_id", F.posexplode(terms)).select(
        "query_id", "pos", "col.text", "col.is_phrase", "col.required", "col.weight"
    )


def _no_markdown(df: DataFrame) -> DataFrame:
    return df.drop("content_markdown")


# --- catalog --------------------------------------------------------------


@query
def markdown_listing(v: Views) -> DataFrame:
    return cat.by_title(cat.list_documents(v.markup_docs().select("file_name")))


@query
def catalog_documents(v: Views) -> DataFrame:
    return cat.by_title(_catalog(v))


@query
def catalog_status_tags(v: Views) -> DataFrame:
    return cat.with_status_tag(_catalog(v)).select("id", "filename", "status_tag")


@query
def category_counts(v: Views) -> DataFrame:
    return cat.category_counts(cat.listing(_library(v)))


@query
def category_filter(v: Views) -> DataFrame:
    return cat.filter_category(cat.listing(_library(v)), fv.CATEGORY_MAYOR, " Acta ").select("id", "title", "filename")


@query
def title_search(v: Views) -> DataFrame:
    return cat.search_titles(cat.listing(_library(v)), "RES 1").select("id", "title", "filename")


@query
def sanitize_names(v: Views) -> DataFrame:
    return v.documents().select("doc_id", names.sanitize_filename(F.col("text")).alias("clean_name"))


@query
def sanitize_upload_names(v: Views) -> DataFrame:
    clean = names.sanitize_upload_name(F.col("file_name"), F.col("key"))
    return _library(v).select("key", clean.alias("upload_name"))


@query
def payload_titles(v: Views) -> DataFrame:
    stem = names.stem(F.col("file_name"))
    return _library(v).select("key", stem.alias("stem"), names.payload_title(stem).alias("title"))


# --- duplicates -----------------------------------------------------------


@query
def duplicate_groups(v: Views) -> DataFrame:
    return dedup.duplicate_groups(_library(v))


@query
def duplicate_summary(v: Views) -> DataFrame:
    return dedup.duplicate_summary(_library(v))


@query
def duplicate_keep(v: Views) -> DataFrame:
    return dedup.duplicate_files(_library(v))


@query
def duplicate_delete_plan(v: Views) -> DataFrame:
    return dedup.delete_plan(_library(v))


@query
def purge_duplicates(v: Views) -> DataFrame:
    return dedup.purge(_library_texts(v), dedup.delete_plan(_library(v)))


# --- ingest planning and reports ------------------------------------------


@query
def pending_files(v: Views) -> DataFrame:
    return ingest.pending_files(_library(v), _stored_names(v)).select("key", "clean_name", "size_bytes")


@query
def pending_outputs(v: Views) -> DataFrame:
    return ingest.pending_outputs(_library(v), _markdown_stems(v), _json_stems(v))


@query
def rejected_files(v: Views) -> DataFrame:
    return ingest.rejected_files(_library(v))


@query
def ingest_errors(v: Views) -> DataFrame:
    """What an ingest run could not take in: unsupported files and pages without a place."""
    return ingest.rejected_files(_library(v)).unionByName(pages.page_errors(v.loose_pages()))


@query
def ingest_plan(v: Views) -> DataFrame:
    library = _library(v)
    in_target = _stored_names(v).select(F.concat(F.lit("RES_"), "file_name").alias("file_name"))
    files = ingest.union_sources(
        {"RES": library, "ORD": v.markup_docs().select(
            F.col("document_id").alias("key"),
            F.concat("document_id", F.lit(".pdf")).alias("file_name"),
            (F.length("markdown") * 1000).cast("long").alias("size_bytes"),
        )}
    )
    return ingest.plan_actions(files, in_target)


@query
def ingest_results(v: Views) -> DataFrame:
    bodies = v.markup_docs()
    files = bodies.select(F.concat("document_id", F.lit(".pdf")).alias("file_name")).unionByName(
        _library(v).select("file_name")
    )
    return ingest.ingest_results(files, fragments.fragments_from_markdown(bodies))


@query
def ingest_report(v: Views) -> DataFrame:
    return ingest.copy_report(v.copy_results())


@query
def copy_savings(v: Views) -> DataFrame:
    return ingest.with_saving(v.copy_results())


@query
def run_summary(v: Views) -> DataFrame:
    return ingest.run_summary(v.run_results())


# --- pages and text -------------------------------------------------------


@query
def assemble_pages(v: Views) -> DataFrame:
    return pages.assemble_pages(v.page_texts())


@query
def vector_heavy(v: Views) -> DataFrame:
    return pages.vector_heavy(v.page_texts())


@query
def select_extraction(v: Views) -> DataFrame:
    marker = "# Acta\n==> picture [1 x 1] intentionally omitted <=="
    number = F.right("document_id", F.lit(6)).cast("int")
    candidates = _page_docs(v).select(
        "document_id",
        F.when(number % 4 == 0, F.lit(marker)).otherwise(F.col("markdown")).alias("structured"),
        F.col("markdown").alias("fallback"),
    )
    return pages.select_extraction(candidates, pages.vector_heavy(v.page_texts()))


@query
def plain_texts(v: Views) -> DataFrame:
    return v.markup_docs().select("document_id", plain_text(F.col("markdown")).alias("content_text"))


# --- fragments ------------------------------------------------------------


@query
def split_sections(v: Views) -> DataFrame:
    return fragments.split_sections(_all_docs(v))


@query
def fragments_of_markdown(v: Views) -> DataFrame:
    return fragments.fragments_from_markdown(_all_docs(v))


@query
def fragments_json_roundtrip(v: Views) -> DataFrame:
    path = new_shared_path(v.spark, "json")
    fragment_store.write_fragments_json(_page_fragments(v), path)
    return fragment_store.read_fragment_lines(v.spark, path)[0]


@query
def fragment_table_roundtrip(v: Views) -> DataFrame:
    path = new_shared_path(v.spark, "table")
    fragment_store.write_fragments(_page_fragments(v), path)
    return fragment_store.read_fragment_table(v.spark, path)


@query
def fragments_of_loose_pages(v: Views) -> DataFrame:
    """Fragments of the pages that have a place; ``ingest_errors`` lists the others."""
    return fragments.fragments_from_pages(v.loose_pages()).select("id", "section", "content_text")


@query
def fragments_of_pages(v: Views) -> DataFrame:
    return _page_fragments(v)


@query
def slim_index(v: Views) -> DataFrame:
    return fragments.slim_index(_page_fragments(v))


@query
def search_haystacks(v: Views) -> DataFrame:
    # A digest per fragment, not one per token.
    digests = _index(v).select("id", F.md5("haystack").alias("haystack_md5"), "tokens")
    return digests.select("id", "haystack_md5", F.explode("tokens").alias("token"))


@query
def viewer_fragments(v: Views) -> DataFrame:
    return fragments.viewer_fragments(_page_fragments(v))


@query
def fragments_per_document(v: Views) -> DataFrame:
    return fragments.fragments_per_document(fragments.fragments_from_markdown(_all_docs(v)))


# --- quality --------------------------------------------------------------


@query
def noise_metrics(v: Views) -> DataFrame:
    return quality.noise_metrics(v.noisy_texts(), "content_text").drop("content_text")


@query
def document_noise(v: Views) -> DataFrame:
    return quality.document_noise(v.noisy_texts())


@query
def scanned_documents(v: Views) -> DataFrame:
    return quality.scanned_documents(v.noisy_texts())


@query
def scanned_markdown(v: Views) -> DataFrame:
    bodies = v.noisy_texts().select(
        F.concat_ws("-", "document_id", "part").alias("document_id"), F.col("content_text").alias("markdown")
    )
    return quality.scanned_markdown(bodies)


# --- search ---------------------------------------------------------------


@query
def search_terms(v: Views) -> DataFrame:
    requests = v.long_requests().unionByName(v.search_requests().select("query_id", "query"))
    return _exploded_terms(requests, query_terms(F.col("query")))


@query
def highlight_term_list(v: Views) -> DataFrame:
    requests = v.long_requests().unionByName(v.search_requests().select("query_id", "query"))
    return _exploded_terms(requests, highlight_terms(F.col("query"))).select("query_id", "pos", "text", "is_phrase")


@query
def search_global(v: Views) -> DataFrame:
    return _hits(v)


@query
def search_global_postings(v: Views) -> DataFrame:
    index = _stored_index(v)
    path = new_shared_path(v.spark, "postings")
    index_store.write_postings(index, path)
    posted, vocab = index_store.read_postings(v.spark, path)
    return search.search_stored(index, v.search_requests(), posted, vocab)


@query
def search_phrases(v: Views) -> DataFrame:
    """Phrases that begin and end inside words, from positional postings."""
    index = _stored_index(v)
    path = new_shared_path(v.spark, "postings")
    index_store.write_postings(index, path)
    posted, vocab = index_store.read_postings(v.spark, path)
    return search.search_stored(index, v.phrase_requests(), posted, vocab)


def _live_index(v: Views) -> str:
    """An index that is built, changed, deleted from and added to, each time by a generation."""
    path = new_shared_path(v.spark, "live")
    made = _stored_fragments(v)
    ordinances = made.where(F.col("document_id").startswith("ORD_"))
    resolutions = made.where(F.col("document_id").startswith("RES_"))
    newer = ordinances.where("chunk_number <= 5").withColumn("section", F.concat(F.lit("v2 "), "section"))
    segments.add_documents(made, path, spread=16)
    segments.add_documents(newer, path, documents=ordinances)
    segments.delete_documents(resolutions, path)
    segments.add_documents(resolutions.where(F.col("document_id").endswith("1")), path)
    return path


@query
def live_index(v: Views) -> DataFrame:
    rows = segments.read_live(v.spark, _live_index(v))
    return rows.select("id", "document_id", "section", "chunk_number", "content_text")


@query
def live_index_search(v: Views) -> DataFrame:
    """Postings of several generations, none of which was written anew."""
    path = _live_index(v)
    posted, vocab = segments.read_live_postings(v.spark, path)
    return search.search_stored(segments.read_live(v.spark, path), v.search_requests(), posted, vocab)


@query
def merged_index_search(v: Views) -> DataFrame:
    path = _live_index(v)
    segments.merge(v.spark, path)
    segments.remove_merged(v.spark, path)
    posted, vocab = segments.read_live_postings(v.spark, path)
    return search.search_stored(segments.read_live(v.spark, path), v.search_requests(), posted, vocab)


@query
def rejected_requests(v: Views) -> DataFrame:
    asked = v.odd_requests()
    limits = search.rejected_requests(
        asked.select(F.col("request_id").alias("query_id"), "query", F.col("request_limit").alias("limit"))
    ).withColumnRenamed("query_id", "request_id")
    return limits.unionByName(viewer.rejected_view_requests(asked))


@query
def search_single(v: Views) -> DataFrame:
    return _no_markdown(search.search_one(_index(v), "Of  the", 100))


@query
def search_filtered(v: Views) -> DataFrame:
    # The equality on an attribute is the operator here.
    index = search.filter_index(_index(v), source="ORD_000005.md")
    return _no_markdown(search.search_one(index, "the", 100))


@query
def search_document(v: Views) -> DataFrame:
    found = viewer.search_fragments(_stored_fragments(v), viewer.check_view_requests(v.view_requests()))
    return found.select("request_id", "id", "chunk_number", "section", "score")


@query
def fragment_page(v: Views) -> DataFrame:
    found = viewer.search_fragments(_stored_fragments(v), viewer.check_view_requests(v.view_requests()))
    return viewer.paginate(found).select(
        "request_id", "id", "score", "position", "page", "page_size", "total", "total_pages"
    )


@query
def page_totals(v: Views) -> DataFrame:
    asked = viewer.check_view_requests(v.view_requests())
    return viewer.page_totals(viewer.search_fragments(_stored_fragments(v), asked), asked)


@query
def fragment_page_of(v: Views) -> DataFrame:
    page = viewer.page_of_fragment(F.col("chunk_number"), F.lit(fv.DEFAULT_PAGE_SIZE))
    return _page_fragments(v).select("id", page.alias("page"))


# --- presentation ---------------------------------------------------------


@query
def hits_with_metadata(v: Views) -> DataFrame:
    return present.with_metadata(_hits(v), cat.listing(_library(v))).select(
        "query_id", "rank", "id", "display_title", "display_file"
    )


@query
def highlight_hits(v: Views) -> DataFrame:
    requests = v.search_requests()
    marked = present.highlight_hits(_hits(v), requests)
    return marked.select("query_id", "rank", "id", "highlighted")


@query
def highlight_fragments(v: Views) -> DataFrame:
    """Whole fragments with the terms of one search marked."""
    marked = present.highlight(F.col("content_text"), present.mark_pattern(F.lit("of the")))
    return _page_fragments(v).select("id", marked.alias("highlighted"))


@query
def snippets(v: Views) -> DataFrame:
    return present.with_snippets(_page_fragments(v)).select("id", "snippet", "preview")


# --- replacing and streaming ----------------------------------------------


def _changed(current: DataFrame) -> DataFrame:
    """A second version of some fragments, and some new ones."""
    older = current.where(F.col("document_id").startswith("ORD_"))
    newer = older.withColumn("section", F.concat(F.lit("v2 "), "section"))
    added = current.where(F.col("document_id").startswith("RES_")).select(
        F.concat(F.lit("N-"), "id").alias("id"), F.concat(F.lit("N-"), "document_id").alias("document_id"),
        "section", "chunk_number",
    )
    return newer.unionByName(added)


@query
def upsert_fragments(v: Views) -> DataFrame:
    current = _stored_fragments(v).select("id", "document_id", "section", "chunk_number")
    return ingest.upsert(current, _changed(current))


@query
def replace_documents(v: Views) -> DataFrame:
    current = _stored_fragments(v).select("id", "document_id", "section", "chunk_number")
    return ingest.replace_documents(current, _changed(current).where("chunk_number <= 5"))


@query
def client_errors(v: Views) -> DataFrame:
    return errors.client_errors(v.client_reports(), _epoch())


def _epoch():
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1e6)


@query
def stream_ingest(v: Views) -> DataFrame:
    path = new_shared_path(v.spark, "ingest")
    markdown_store.write_markdown(_page_docs(v), f"{path}/markdown")
    docs = streaming.stream_markdown_table(v.spark, f"{path}/markdown")
    streaming.stream_ingest(docs, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return streaming.read_store(v.spark, f"{path}/store")


def _pages_in_parts(v: Views, pages: DataFrame, path: str, parts: int) -> DataFrame:
    """Pages as a stream of one batch per ``part``; the files of a part are written one after the other part's.

    Pages stay in the tasks that read them, so no file is larger than what a task reads.
    """
    for part in range(parts):
        pages.where(F.col("part") == part).drop("part").write.mode("append").parquet(path)
    files = len(v.spark.read.parquet(path).inputFiles())
    return streaming.stream_pages_table(v.spark, path, max_files=max(1, -(-files // parts)))


@query
def stream_ingest_pages(v: Views) -> DataFrame:
    # The pages of a document come in three batches; pages without a number come with the first.
    path = new_shared_path(v.spark, "ingest")
    part = F.coalesce(F.pmod(F.col("page_no"), F.lit(3)), F.lit(0))
    pages_in = _pages_in_parts(v, v.page_texts().withColumn("part", part), f"{path}/pages", 3)
    streaming.stream_ingest_pages(pages_in, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return streaming.read_store(v.spark, f"{path}/store")


@query
def stream_uploads(v: Views) -> DataFrame:
    """Two uploads of every page, page by page in any order; the second one has other numbers of drawings and text."""
    path = new_shared_path(v.spark, "ingest")
    first = v.page_texts().withColumn("page_text", F.lit("old")).withColumn("upload", F.lit(1).cast("long"))
    second = v.page_texts().where("page_no % 4 <> 0").withColumn("upload", F.lit(2).cast("long"))
    both = first.unionByName(second).withColumn("part", F.pmod(F.col("page_no") + F.col("upload"), F.lit(2)))
    pages_in = _pages_in_parts(v, both, f"{path}/pages", 2)
    streaming.stream_ingest_pages(pages_in, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return streaming.read_store(v.spark, f"{path}/store").select("id", "document_id", "chunk_number", "section", "content_text")


@query
def repeated_pages(v: Views) -> DataFrame:
    """Pages given several times keep apart: as many ids as in the assembled body, none twice."""
    twice = v.page_texts().where("page_no % 3 = 1 and page_no < 9")
    found = fragments.fragments_from_pages(v.page_texts().unionByName(twice))
    return found.groupBy("document_id").agg(
        F.count("*").alias("n_fragments"), F.count_distinct("id").alias("n_ids"), F.max("chunk_number").alias("last_number")
    )


@query
def repeated_bodies(v: Views) -> DataFrame:
    docs = v.markup_docs()
    return fragments.repeated_bodies(docs.unionByName(docs.where("document_id like '%_x'")))


@query
def stream_client_errors(v: Views) -> DataFrame:
    path = new_shared_path(v.spark, "errors")
    rows = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    reports = rows.where("event_type = 'error'").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"),
        F.col("event_type").alias("source"),
        (F.col("event_id") % 1000).cast("int").alias("lineno"),
        F.lit(0).alias("colno"),
        F.col("props").alias("stack"),
        _epoch().alias("seen_at"),
    )
    streaming.stream_client_errors(
        reports, f"{path}/errors", f"{path}/checkpoint", F.col("seen_at")
    ).awaitTermination()
    return v.spark.read.parquet(f"{path}/errors")
