"""Incremental ingest: new Markdown files or table rows become fragments as they arrive.

The store is two append-only Parquet tables with one folder per micro-batch:

* ``fragments/batch_id=N`` holds the fragments of the documents of batch N;
* ``ledger/batch_id=N`` names those documents, also ones without a fragment.

A batch that is repeated after a failure overwrites its own folders, and a
reader takes each document from its newest batch, so a document that comes
again replaces all of its earlier fragments.

A store of pages has two more of the kind:

* ``pages/batch_id=N`` holds the pages that came with batch N;
* ``errors/batch_id=N`` names pages without a place.

The pages of an upload may come in any number of batches.  A batch cuts every
document it touches anew, from all pages of its latest upload so far, as pages
that come later move the numbers of the fragments after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from doclake import schemas
from doclake.operators.fragments import fragments_from_markdown, fragments_from_pages
from doclake.operators.pages import page_errors
from doclake.session import intermediate, lookup_join, path_exists, stored
from doclake.sources.client_errors import client_errors
from doclake.sources.markdown import with_identity

_BATCH = T.StructField("batch_id", T.LongType())
STORED_FRAGMENT = T.StructType([*schemas.FRAGMENT.fields, _BATCH])
LEDGER = T.StructType([T.StructField("document_id", T.StringType()), _BATCH])
STORED_PAGE = T.StructType([*schemas.PAGE_UPLOAD.fields, _BATCH])


def stream_markdown(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Markdown files of a folder as a stream; the checkpoint remembers what was read."""
    bodies = (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", "*.md")
        .text(path, wholetext=True)
    )
    return with_identity(bodies)


def stream_markdown_table(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Rows added to a Markdown table as a stream."""
    rows = spark.readStream.schema(schemas.MARKDOWN).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.withColumn("modified_at", F.col("_metadata.file_modification_time"))


def newest_bodies(docs: DataFrame) -> DataFrame:
    """One body per document, the one modified last; a maximum, so copies do not pile up in a task."""
    newest = F.max(F.struct("modified_at", "file_name", "markdown")).alias("newest")
    return docs.groupBy("document_id").agg(newest).select("document_id", "newest.file_name", "newest.markdown")


def _write_batch(store: str, batch_id: int, fragments: DataFrame, documents: DataFrame) -> None:
    fragments.write.mode("overwrite").parquet(f"{store}/fragments/batch_id={batch_id}")
    documents.write.mode("overwrite").parquet(f"{store}/ledger/batch_id={batch_id}")


def _store_batch(store: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Read and reduced once, for fragments and ledger.
        with intermediate(batch.sparkSession):
            docs = stored(newest_bodies(batch), "batch")
            _write_batch(store, batch_id, fragments_from_markdown(docs), docs.select("document_id"))

    return write


def _store_pages(store: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pages = _with_upload(batch)
        page_errors(pages).write.mode("overwrite").parquet(f"{store}/errors/batch_id={batch_id}")
        placed = pages.where(F.col("document_id").isNotNull() & F.col("page_no").isNotNull())
        placed.write.mode("overwrite").parquet(f"{store}/pages/batch_id={batch_id}")
        with intermediate(spark):
            touched = stored(
                spark.read.schema(schemas.PAGE_UPLOAD).parquet(f"{store}/pages/batch_id={batch_id}")
                .select("document_id").distinct(),
                "touched",
            )
            so_far = current_pages(spark, store, touched, batch_id)
            _write_batch(store, batch_id, fragments_from_pages(so_far), touched)

    return write


def _with_upload(pages: DataFrame) -> DataFrame:
    """Pages without an upload number belong to upload 0."""
    upload = F.col("upload") if "upload" in pages.columns else F.lit(None)
    return pages.select(*schemas.PAGE_TEXT.fieldNames(), F.coalesce(upload.cast("long"), F.lit(0)).alias("upload"))


def current_pages(spark: SparkSession, store: str, documents: DataFrame, last_batch: int) -> DataFrame:
    """The pages of the latest upload of some documents, as of a batch.

    Of a page number that an upload sent in several batches the latest counts, so
    a page can be sent again; copies inside one batch stay.  The pages of other
    documents are dropped by a join on the id before anything is shuffled, and
    batches that hold no page of these documents are not read beyond their ids.
    """
    kept = spark.read.schema(STORED_PAGE).parquet(f"{store}/pages").where(F.col("batch_id") <= last_batch)
    ours = lookup_join(kept, documents, "document_id", "left_semi")
    numbers = lookup_join(
        kept.select("document_id", "page_no", "upload", "batch_id"), documents, "document_id", "left_semi"
    )
    newest = numbers.groupBy("document_id").agg(F.max("upload").alias("upload"))
    latest = lookup_join(numbers, newest, ["document_id", "upload"], "left_semi")
    latest = latest.groupBy("document_id", "page_no", "upload").agg(F.max("batch_id").alias("batch_id"))
    found = lookup_join(ours, latest, ["document_id", "page_no", "upload", "batch_id"], "left_semi")
    return found.select(*schemas.PAGE_TEXT.fieldNames())


def stream_ingest(docs: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes in everything that is there and then ends."""
    return (
        docs.writeStream.foreachBatch(_store_batch(store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_pages_table(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Rows added to a page table, with or without upload numbers, as a stream."""
    return spark.readStream.schema(schemas.PAGE_UPLOAD).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_ingest_pages(pages: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Take in pages as they are uploaded; no body is put together.

    An upload may be spread over any number of batches, and one with a larger
    number replaces the document.  Pages that come late for an upload that was
    replaced change nothing.  Pages without a place go to the store's ``errors``.
    """
    return (
        pages.writeStream.foreachBatch(_store_pages(store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Current fragments: those of each document's newest batch; none before the first batch."""
    if not path_exists(spark, f"{store}/ledger"):
        names = schemas.FRAGMENT.fields
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in names))
    fragments = spark.read.schema(STORED_FRAGMENT).parquet(f"{store}/fragments")
    ledger = spark.read.schema(LEDGER).parquet(f"{store}/ledger")
    newest = ledger.groupBy("document_id").agg(F.max("batch_id").alias("batch_id"))
    current = lookup_join(fragments, newest, ["document_id", "batch_id"], "left_semi")
    return current.select(*schemas.FRAGMENT.fieldNames())


def compact_store(spark: SparkSession, store: str, path: str) -> None:
    """Write the current fragments as a plain fragment table."""
    from doclake.sources.fragments import write_fragments

    write_fragments(read_store(spark, store), path)


def stream_client_errors(
    reports: DataFrame, path: str, checkpoint: str, received_at: Column | None = None
) -> StreamingQuery:
    """Append error reports to a table as they come in."""
    return (
        client_errors(reports, received_at)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
