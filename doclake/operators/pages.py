"""Page tables to Markdown: assembling pages and choosing between two extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions.text import LINE_BREAK, is_blank, or_empty, strip
from doclake.session import lookup_join

PAGE_BLOCK = 64


def page_part(page_no: Column, page_text: Column) -> Column:
    """Markdown of one page: its header, then its text or the note for a blank page."""
    body = F.when(is_blank(or_empty(page_text)), F.lit(fv.BLANK_PAGE_TEXT)).otherwise(page_text)
    return F.concat(
        F.lit(fv.PAGE_HEADER_PREFIX), page_no.cast("string"), F.lit(fv.PAGE_HEADER_SUFFIX), body
    )


def page_digest(part: Column) -> Column:
    """Puts pages of one number in an order that needs no more than a number of each."""
    return F.xxhash64(part)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """``(document_id, file_name, markdown)``: one body per document, its pages in order.

    A page number given more than once stays as often, in the order of
    :func:`page_digest`.

    Pages are joined in blocks of ``PAGE_BLOCK`` page numbers first and the
    blocks next, so no task sorts the pages of a whole document; a body itself
    is as long as its document.  Pages without a document or number have no
    place in a body, see :func:`page_errors`.  To get fragments use
    :func:`doclake.operators.fragments.fragments_from_pages`, which needs no
    body at all.
    """
    part = page_part(F.col("page_no"), F.col("page_text"))
    parts = pages.where(F.col("document_id").isNotNull() & F.col("page_no").isNotNull()).select(
        "document_id",
        F.floor(F.col("page_no") / PAGE_BLOCK).alias("block"),
        F.struct("page_no", page_digest(part).alias("digest"), part.alias("part")).alias("page"),
    )
    blocks = parts.groupBy("document_id", "block").agg(_in_order("page").alias("part"))
    bodies = blocks.groupBy("document_id").agg(_in_order(F.struct("block", "part")).alias("markdown"))
    return bodies.select("document_id", F.concat("document_id", F.lit(".md")).alias("file_name"), "markdown")


def _in_order(parts: Column | str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda x: x["part"]), "")


def page_errors(pages: DataFrame) -> DataFrame:
    """``(filename, status, error)`` for pages that no document or number places."""
    lost = pages.where(F.col("document_id").isNull() | F.col("page_no").isNull())
    return lost.select(
        F.coalesce("document_id", F.lit("")).alias("filename"),
        F.lit("error").alias("status"),
        F.when(F.col("document_id").isNull(), F.lit("Página sin documento")).otherwise(F.lit("Página sin número")).alias("error"),
    )


def vector_heavy(pages: DataFrame) -> DataFrame:
    """``(document_id, is_vector_heavy)``: many drawings on one of the first pages."""
    many = (F.col("page_no") <= fv.DRAWINGS_PAGES) & (F.col("drawings") > fv.DRAWINGS_LIMIT)
    return pages.groupBy("document_id").agg(F.bool_or(F.coalesce(many, F.lit(False))).alias("is_vector_heavy"))


def _body_chars(markdown: Column) -> Column:
    """Characters of real text: no image markers, blank lines or headers."""
    for marker in fv.IMAGE_MARKERS:
        markdown = F.replace(markdown, F.lit(marker), F.lit(""))
    lines = F.filter(
        F.split(markdown, LINE_BREAK, -1),
        lambda line: ~is_blank(line) & ~strip(line).startswith("#"),
    )
    return F.length(strip(F.array_join(lines, "")))


def select_extraction(candidates: DataFrame, heavy: DataFrame) -> DataFrame:
    """``(document_id, used_fallback, markdown)`` out of ``(document_id, structured, fallback)``.

    The structured text is dropped for vector-heavy documents; the fallback is
    taken when the structured text is almost empty and the fallback is not.
    """
    # Only the ids of heavy documents meet the texts, which need no shuffle while those are few.
    marked = heavy.where("is_vector_heavy").select("document_id", "is_vector_heavy")
    joined = lookup_join(candidates, marked, "document_id", "left")
    dropped = F.coalesce("is_vector_heavy", F.lit(False))
    structured = F.when(dropped, F.lit("")).otherwise(or_empty(F.col("structured")))
    chosen = joined.select(
        "document_id", structured.alias("structured"), or_empty(F.col("fallback")).alias("fallback")
    )
    use_fallback = (_body_chars(F.col("structured")) < fv.MIN_STRUCTURED_CHARS) & (
        F.length(strip(F.col("fallback"))) > fv.MIN_FALLBACK_CHARS
    )
    return chosen.withColumn("used_fallback", use_fallback).select(
        "document_id",
        "used_fallback",
        F.when(F.col("used_fallback"), F.col("fallback")).otherwise(F.col("structured")).alias("markdown"),
    )
