"""Search and paging inside documents, for a batch of view requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions.terms import query_terms
from doclake.operators.fragments import fragment_haystack
from doclake.operators.ranking import BLOCK, with_position
from doclake.operators.search import has_required_terms, score_document
from doclake.session import lookup_join


def check_view_requests(requests: DataFrame) -> DataFrame:
    """Requests in the allowed range, with default page values.

    The others are in :func:`rejected_view_requests`.
    """
    page, size = _page_values()
    return requests.where((page >= 1) & size.between(1, fv.MAX_PAGE_SIZE)).select(
        "request_id", "document_id", "query", page.alias("page"), size.alias("page_size")
    )


def _page_values() -> tuple[Column, Column]:
    return F.coalesce("page", F.lit(1)), F.coalesce("page_size", F.lit(fv.DEFAULT_PAGE_SIZE))


def rejected_view_requests(requests: DataFrame) -> DataFrame:
    """``(request_id, field, value)`` for every page or page size out of range."""
    page, size = _page_values()
    wrong = F.array(
        F.when(page < 1, F.struct(F.lit("page").alias("field"), page.cast("long").alias("value"))),
        F.when(~size.between(1, fv.MAX_PAGE_SIZE), F.struct(F.lit("page_size").alias("field"), size.cast("long").alias("value"))),
    )
    return requests.select("request_id", F.explode(wrong).alias("w")).where("w is not null").select("request_id", "w.*")


def unknown_documents(fragments: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for documents that have no fragments; they are errors, not empty pages."""
    return requests.join(fragments.select("document_id").distinct(), "document_id", "left_anti")


def search_fragments(fragments: DataFrame, requests: DataFrame) -> DataFrame:
    """Scored fragments of the requested documents that hold all required terms."""
    text, terms = F.col("_text"), F.col("terms")
    asked = requests.withColumn("terms", query_terms(F.col("query"))).drop("query")
    return (
        lookup_join(fragments.withColumn("_text", fragment_haystack()), asked, "document_id", "inner")
        .where(has_required_terms(text, terms))
        .withColumn("score", score_document(text, terms))
        .drop("_text", "terms")
    )


def page_count(total: Column, page_size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / page_size)).cast("int")


def paginate(scored: DataFrame) -> DataFrame:
    """The asked page of each request, best score first, then in document order.

    A page past the end becomes the last page.  Positions are built from block
    counts, so a request over a huge document is not sorted in one task.
    """
    blocked = scored.withColumn("_rank", -F.col("score")).withColumn(
        "_block", F.floor(F.col("chunk_number") / BLOCK)
    )
    placed = with_position(blocked, ["request_id"], ["_rank", "_block"], ["chunk_number", "id"])
    paged = placed.withColumn("total_pages", page_count(F.col("group_total"), F.col("page_size"))).withColumn(
        "page", F.least("page", "total_pages")
    )
    first = (F.col("page") - 1) * F.col("page_size")
    return (
        paged.where((F.col("position") > first) & (F.col("position") <= first + F.col("page_size")))
        .withColumnRenamed("group_total", "total")
        .drop("_rank", "_block")
    )


def page_totals(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request_id, page, page_size, total, total_pages)``, requests without a fragment included."""
    totals = scored.groupBy("request_id").agg(F.count(F.lit(1)).alias("total"))
    return (
        requests.join(totals, "request_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("total_pages", page_count(F.col("total"), F.col("page_size")))
        .select("request_id", F.least("page", "total_pages").alias("page"), "page_size", "total", "total_pages")
    )


def page_of_fragment(chunk_number: Column, page_size: Column) -> Column:
    """Page that is opened for a fragment; it goes by number, not by position."""
    return F.greatest(F.lit(1), F.ceil(chunk_number / page_size)).cast("int")
