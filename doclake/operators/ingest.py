"""Ingest: what is pending, what to do with it, replacing records, run reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions import fixed_values as fv
from doclake.functions import names
from doclake.operators.catalog import with_flags
from doclake.operators.fragments import fragments_per_document
from doclake.session import lookup_join


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """One listing out of several, each under its prefix."""
    tagged = [df.withColumn("prefix", F.lit(prefix)) for prefix, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged)


def rejected_files(library: DataFrame) -> DataFrame:
    """Files with a suffix that is not supported, as error rows."""
    return library.where(~names.is_supported(F.col("file_name"))).select(
        F.col("file_name").alias("filename"),
        F.lit("error").alias("status"),
        F.concat(F.lit("Formato no soportado: "), names.suffix(F.col("file_name"))).alias("error"),
    )


def pending_files(library: DataFrame, stored: DataFrame) -> DataFrame:
    """Supported files, under their clean name, that the store does not have yet."""
    clean = library.where(names.is_supported(F.col("file_name"))).withColumn(
        "clean_name", names.sanitize_filename(F.col("file_name"))
    )
    have = stored.select(F.col("file_name").alias("clean_name")).where(F.col("clean_name") != "").distinct()
    return lookup_join(clean, have, "clean_name", "left_anti")


def pending_outputs(library: DataFrame, markdown_stems: DataFrame, json_stems: DataFrame) -> DataFrame:
    """Supported files whose Markdown or JSON is missing; both tables hold stems (``id``)."""
    clean = names.sanitize_filename(F.col("file_name"))
    files = library.where(names.is_supported(F.col("file_name"))).select(
        "key", "file_name", names.stem(clean).alias("id")
    )
    flagged = with_flags(files, "id", has_markdown=markdown_stems, has_json=json_stems)
    return flagged.where(~F.col("has_markdown") | ~F.col("has_json"))


def plan_actions(files: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each ``(prefix, file_name, size_bytes)``: skip, compress or copy.

    ``existing`` lists the names that are in the target already (``file_name``).
    """
    name = F.col("file_name")
    target = F.concat_ws("_", F.col("prefix"), names.sanitize_filename(name))
    planned = files.where(names.is_supported(name)).withColumn("target_name", target)
    done = existing.select(F.col("file_name").alias("target_name"))
    flagged = with_flags(planned, "target_name", _done=done)
    big_pdf = (names.suffix(name) == ".pdf") & (F.col("size_bytes") > fv.COMPRESS_OVER_BYTES)
    action = F.when(F.col("_done"), "skip").when(big_pdf, "compress").otherwise("copy")
    return flagged.select("prefix", "file_name", "size_bytes", "target_name", action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Add rows, replacing those with the same key.

    Of several new rows with one key the largest wins, column by column in the
    order of the table; keys of the result are unique if those of ``current`` are.
    """
    others = [c for c in incoming.columns if c != key]
    largest = F.max(F.struct(*others)).alias("_row")
    newest = incoming.groupBy(key).agg(largest).select(key, "_row.*").select(*incoming.columns)
    kept = lookup_join(current, newest.select(key), key, "left_anti")
    return kept.unionByName(newest)


def replace_documents(current: DataFrame, incoming: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Replace whole documents, so that no fragment of an older version stays.

    ``documents`` names the documents that were read, also those that have no
    fragment any more; without it they are taken from ``incoming``.
    """
    read = incoming if documents is None else documents
    kept = lookup_join(current, read.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(incoming)


def ingest_results(files: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row per ingested file: where its outputs are and how many fragments it gave."""
    made = fragments_per_document(fragments)
    stem = names.stem(F.col("file_name"))
    outputs = files.select(
        stem.alias("document_id"),
        F.col("file_name").alias("source_file"),
        F.concat(F.lit("markdown/"), stem, F.lit(".md")).alias("markdown_path"),
        F.concat(F.lit("json/"), stem, F.lit(".json")).alias("json_path"),
    )
    return lookup_join(outputs, made, "document_id", "left").select(
        "source_file", "markdown_path", "json_path", F.coalesce("documents_created", F.lit(0)).alias("documents_created")
    )


def _count_status(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def run_summary(results: DataFrame) -> DataFrame:
    """One row over run results: successes, errors, fragments made, time spent."""
    made = F.when(F.col("status") == "success", F.coalesce("docs_created", F.lit(0))).otherwise(0)
    return results.agg(
        _count_status("success").alias("processed"),
        _count_status("error").alias("errors"),
        F.coalesce(F.sum(made), F.lit(0)).alias("total_fragments"),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("total_seconds"),
    )


def stored_bytes() -> Column:
    """Bytes a copy result leaves in the target: a compressed file its new size, a failed one none."""
    return (
        F.when(F.col("status") == "error", F.lit(0).cast("long"))
        .when(F.col("status").isin("compressed", "skipped"), F.coalesce("comp_size", "orig_size"))
        .otherwise(F.col("orig_size"))
    )


def with_saving(results: DataFrame) -> DataFrame:
    """Add ``saved_percent`` to the files that were compressed."""
    gain = F.try_divide((F.col("orig_size") - F.col("comp_size")).cast("double"), F.col("orig_size").cast("double"))
    return results.withColumn("saved_percent", F.when(F.col("status") == "compressed", F.round(gain * 100, 1)))


def copy_report(results: DataFrame) -> DataFrame:
    """One row over copy results; a timeout is also a copy, of the original."""
    return results.agg(
        _count_status("compressed").alias("compressed"),
        F.count_if(F.col("status").isin("copied", "timeout")).alias("copied"),
        _count_status("timeout").alias("timeouts"),
        _count_status("error").alias("errors"),
        _count_status("skipped").alias("skipped"),
        F.coalesce(F.sum(stored_bytes()), F.lit(0)).alias("total_bytes"),
    )
