"""Markdown or pages to numbered fragments, and the projections of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions import chunking, names
from doclake.functions import fixed_values as fv
from doclake.functions.text import haystack, is_blank, or_empty, plain_text, strip
from doclake.operators.pages import PAGE_BLOCK, page_digest, page_part
from doclake.operators.postings import text_tokens
from doclake.operators.ranking import block_starts
from doclake.session import lookup_join, stored

FRAGMENT_COLUMNS = [
    "id", "document_id", "title", "section", "chunk_number", "source", "content_markdown", "content_text",
]


def split_sections(docs: DataFrame) -> DataFrame:
    """``(document_id, sec_no, section, content)`` of ``(document_id, markdown)``."""
    return docs.select("document_id", F.posexplode(chunking.sections(F.col("markdown")))).select(
        "document_id", (F.col("pos") + 1).alias("sec_no"), "col.section", "col.content"
    )


def _to_fragments(numbered: DataFrame) -> DataFrame:
    """Pieces ``(document_id, title, source, chunk_number, section, content)`` to fragment rows.

    Blank pieces are dropped here, after numbering, so numbers may have gaps.
    """
    return numbered.where(F.col("content") != "").select(
        F.concat("document_id", F.lit("-fragment-"), F.col("chunk_number").cast("string")).alias("id"),
        "document_id",
        "title",
        "section",
        F.col("chunk_number").cast("int").alias("chunk_number"),
        "source",
        F.col("content").alias("content_markdown"),
        plain_text(F.col("content")).alias("content_text"),
    )


def fragments_from_markdown(docs: DataFrame, max_chars: int = fv.MAX_FRAGMENT_CHARS) -> DataFrame:
    """Fragments of ``(document_id, file_name, markdown)`` without any shuffle.

    Ids are unique where a document has one body, see :func:`one_body`.
    """
    pieces = chunking.pieces(chunking.sections(F.col("markdown")), max_chars)
    # The title is made per document, before its pieces are.
    titled = docs.withColumn("title", names.payload_title(F.col("document_id")))
    numbered = titled.select(
        "document_id", "title", F.col("file_name").alias("source"), F.posexplode(pieces)
    ).select(
        "document_id", "title", "source", (F.col("pos") + 1).alias("chunk_number"), "col.section", "col.content"
    )
    return _to_fragments(numbered)


def one_body(docs: DataFrame) -> DataFrame:
    """``(document_id, file_name, markdown)`` with one row per document: of several bodies the largest.

    A maximum, so copies do not pile up in a task; the others are named by
    :func:`repeated_bodies`.
    """
    most = F.max(F.struct("file_name", "markdown")).alias("most")
    return docs.groupBy("document_id").agg(most).select("document_id", "most.file_name", "most.markdown")


def repeated_bodies(docs: DataFrame) -> DataFrame:
    """``(filename, status, error)`` for documents that have more than one body."""
    return docs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.coalesce("document_id", F.lit("")).alias("filename"),
        F.lit("error").alias("status"),
        F.concat(F.lit("Documento repetido: "), F.col("n").cast("string")).alias("error"),
    )


def fragments_from_pages(pages: DataFrame, max_chars: int = fv.MAX_FRAGMENT_CHARS) -> DataFrame:
    """Same fragments as assembling the pages first, without assembling them.

    A page starts with a header line, so no section reaches over a page end and
    pages are cut one by one.  What a page needs from the rest of its document
    is the number of pieces before it.  Pages are grouped in blocks of
    ``PAGE_BLOCK`` page numbers: pieces per block are counted with a partial
    aggregate, and inside a block a window counts on.  However many pages a
    document has, a task holds one block of them at a time.

    The blank lines in front of the first header are a (blank) piece of their
    own in the assembled body; it is the 1 in the numbering.

    Pieces are cut once, numbered within their page and written to the shared
    folder; the counts are read from there, and pieces need no shuffle while the
    counts are few.  A page number given more than once is numbered as often, in
    the order of the assembled body.  Pages without a document or number give no
    fragment, see :func:`doclake.operators.pages.page_errors`.
    """
    part = page_part(F.col("page_no"), F.col("page_text"))
    body = F.ltrim(part, F.lit("\n"))
    # The row number tells pages of one number and text apart; it is written before it is used.
    rows = pages.withColumn("page_row", F.monotonically_increasing_id())
    placed = rows.where(F.col("document_id").isNotNull() & F.col("page_no").isNotNull())
    cut = placed.select(
        "document_id",
        "page_no",
        F.floor(F.col("page_no") / PAGE_BLOCK).alias("page_block"),
        page_digest(part).alias("digest"),
        "page_row",
        F.posexplode_outer(chunking.pieces(chunking.sections(body), max_chars)),
    )
    page = ["document_id", "page_no", "page_row"]
    pieces = stored(cut.select(*page, "page_block", "digest", "pos", "col.*"), "pieces")
    counts = pieces.groupBy(*page, "page_block", "digest").agg(F.count("pos").alias("n"))
    starts = block_starts(counts, ["document_id"], ["page_block"], F.col("n")).drop("group_total")
    earlier = (
        Window.partitionBy("document_id", "page_block")
        .orderBy("page_no", "digest", "page_row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    firsts = before.join(starts, ["document_id", "page_block"]).select(
        *page, (F.col("block_start") + F.col("_before") + 2).alias("_first")
    )
    numbered = lookup_join(pieces, firsts, page, "inner").select(
        "document_id",
        names.payload_title(F.col("document_id")).alias("title"),
        F.concat("document_id", F.lit(".md")).alias("source"),
        (F.col("_first") + F.col("pos")).alias("chunk_number"),
        "section",
        "content",
    )
    return _to_fragments(numbered)


def slim_index(fragments: DataFrame) -> DataFrame:
    """The search index: fragments without their Markdown."""
    return fragments.drop("content_markdown")


def index_haystack() -> Column:
    """Text a search over the whole library looks into."""
    return haystack(F.col("title"), F.col("section"), F.col("content_text"))


def fragment_haystack() -> Column:
    """Text a search inside one document looks into."""
    return haystack(F.col("section"), F.col("content_text"))


def with_search_text(index: DataFrame) -> DataFrame:
    """Add the haystack and its distinct tokens."""
    return index.withColumn("haystack", index_haystack()).withColumn("tokens", text_tokens(F.col("haystack")))


def search_index(fragments: DataFrame) -> DataFrame:
    """The slim index ready to be searched; write it once and search it often."""
    return with_search_text(slim_index(fragments))


def viewer_fragments(fragments: DataFrame) -> DataFrame:
    """What the document view shows: non-blank fragments and their length."""
    body = strip(or_empty(F.col("content_markdown")))
    return fragments.where(~is_blank(or_empty(F.col("content_markdown")))).select(
        F.concat("document_id", F.lit("-fragment-"), F.col("chunk_number").cast("string")).alias("id"),
        "document_id",
        "chunk_number",
        or_empty(F.col("section")).alias("section"),
        body.alias("content_markdown"),
        or_empty(F.col("content_text")).alias("content_text"),
        F.length(body).alias("char_count"),
    )


def fragments_per_document(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("document_id").agg(F.count(F.lit(1)).alias("documents_created"))


def documents_fragments(fragments: DataFrame, document_id: str) -> DataFrame:
    """Fragments of one document; an unknown document is an error."""
    found = fragments.where(F.col("document_id") == document_id)
    if found.isEmpty():
        raise LookupError(document_id)
    return found
