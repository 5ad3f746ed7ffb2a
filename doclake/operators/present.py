"""Hits for display: catalog data, snippets and marked terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.terms import highlight_terms
from doclake.functions.text import SPACE_CLASS, escape_html, preview, snippet
from doclake.session import lookup_join

# What a space inside a term may stand for, and the marks.
SPACE_IN_TEXT = rf"(?:[{SPACE_CLASS}]+|<br[{SPACE_CLASS}]*/?>|&lt;br[{SPACE_CLASS}]*/?&gt;)+"
MARKED = "<mark>$1</mark>"


def with_metadata(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the catalog's title and file name, or the hit's own where the catalog has none.

    Several files can have one id; the first by title and file name is used.
    """
    entry = F.min(F.struct(F.col("title").alias("catalog_title"), F.col("original_filename")))
    known = catalog.groupBy(F.col("id").alias("document_id")).agg(entry.alias("entry"))
    return (
        lookup_join(hits, known, "document_id", "left")
        .withColumn("display_title", F.coalesce("entry.catalog_title", F.nullif("title", F.lit("")), "document_id"))
        .withColumn("display_file", F.coalesce("entry.original_filename", F.col("source"), F.lit("")))
        .drop("entry")
    )


def longest_first(terms: Column) -> Column:
    """Term texts, longest first; terms of one length keep their order."""
    keyed = F.transform(
        terms, lambda t, i: F.struct((-F.length(t["text"])).alias("n"), i.alias("i"), t["text"].alias("text"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["text"])


def mark_pattern(query: Column) -> Column:
    """Regex that finds the terms of a search; null for a search without terms."""

    def one(term: Column) -> Column:
        escaped = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
        return F.replace(escaped, F.lit(" "), F.lit(SPACE_IN_TEXT))

    terms = F.transform(longest_first(highlight_terms(query)), one)
    return F.when(F.size(terms) > 0, F.concat(F.lit("(?iu)("), F.array_join(terms, "|"), F.lit(")")))


def highlight(text: Column, pattern: Column) -> Column:
    """Escape a text for HTML and mark the terms; a text without a term is only escaped."""
    escaped = escape_html(text)
    return F.when(F.rlike(text, pattern), F.regexp_replace(escaped, pattern, F.lit(MARKED))).otherwise(escaped)


def with_snippets(hits: DataFrame) -> DataFrame:
    return hits.withColumn("snippet", snippet(F.col("content_text"))).withColumn(
        "preview", preview(F.col("content_text"))
    )


def highlight_hits(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Add the marked snippet to hits, given the requests they answer."""
    patterns = requests.select("query_id", mark_pattern(F.col("query")).alias("_pattern"))
    return (
        lookup_join(with_snippets(hits), patterns, "query_id", "inner")
        .withColumn("highlighted", highlight(F.col("snippet"), F.col("_pattern")))
        .drop("_pattern")
    )
