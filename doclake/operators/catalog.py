"""The document catalog: one row per library file, with lookups and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions import names
from doclake.session import lookup_join


def with_flags(df: DataFrame, key: str, **flags: DataFrame) -> DataFrame:
    """Add boolean columns: does the row's key occur in the table given for the flag?

    All tables are made into one lookup with one row per key, so there is one
    join and a row never multiplies.
    """
    marks = reduce(
        DataFrame.unionByName,
        [
            table.select(key, *[F.lit(name == flag).alias(name) for name in flags])
            for flag, table in flags.items()
        ],
    )
    lookup = marks.groupBy(key).agg(*[F.bool_or(name).alias(name) for name in flags])
    joined = lookup_join(df, lookup, key, "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(False)) for name in flags})


def list_documents(markdown_files: DataFrame) -> DataFrame:
    """``(id, title, filename)`` of Markdown files given by ``file_name``."""
    stem = names.stem(F.col("file_name"))
    return markdown_files.where(F.col("file_name").endswith(".md")).select(
        stem.alias("id"), names.humanize_stem(stem).alias("title"), F.col("file_name").alias("filename")
    )


def listing(library: DataFrame) -> DataFrame:
    """The catalog without its flags, from the names alone; enough to count, filter and search titles."""
    name = F.col("file_name")
    return library.where(name != "").select(
        names.stem(name).alias("id"),
        names.display_name(name).alias("title"),
        name.alias("filename"),
        names.original_filename(name).alias("original_filename"),
        names.category(names.stem(name)).alias("category"),
    )


def catalog(library: DataFrame, markdown_stems: DataFrame, scanned: DataFrame) -> DataFrame:
    """Catalog of a library listing.

    ``markdown_stems`` has the stems that are converted (``id``), ``scanned``
    the ids of scanned documents (``document_id``).
    """
    files = listing(library)
    ids_scanned = scanned.select(F.col("document_id").alias("id"))
    return with_flags(files, "id", converted=markdown_stems, is_scanned=ids_scanned).select(
        "id", "title", "filename", "original_filename", "converted", "is_scanned", "category"
    )


def document_markdown(docs: DataFrame, document_id: str) -> str:
    """The body of one document; an unknown document is an error."""
    row = docs.where(F.col("document_id") == document_id).select("markdown").first()
    if row is None:
        raise LookupError(document_id)
    return row["markdown"]


def by_title(df: DataFrame) -> DataFrame:
    return df.orderBy("title", "id")


def with_status_tag(df: DataFrame) -> DataFrame:
    return df.withColumn("status_tag", names.status_tag(F.col("is_scanned"), F.col("converted")))


def category_counts(df: DataFrame) -> DataFrame:
    """Documents per category; every category is listed, also with no document."""
    spark = df.sparkSession
    counted = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    all_categories = spark.createDataFrame([(c,) for c in fv.CATEGORIES], "category string")
    return all_categories.join(counted, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("n_documents")
    )


def title_matches(query: Column) -> Column:
    wanted = F.lower(query)
    shown_name = F.coalesce(F.nullif("original_filename", F.lit("")), F.col("filename"))
    in_title = F.contains(F.lower(F.coalesce("title", F.lit(""))), wanted)
    return in_title | F.contains(F.lower(F.coalesce(shown_name, F.lit(""))), wanted)


def search_titles(df: DataFrame, query: str) -> DataFrame:
    """Documents whose title or shown file name contains the search string."""
    return df.where(title_matches(F.lit(query)))


def filter_category(df: DataFrame, category: str, text: str = "") -> DataFrame:
    """Documents of a category, narrowed down by a filter text if there is one."""
    chosen = df.where(F.col("category") == category)
    text = text.strip()
    return search_titles(chosen, text) if text else chosen
