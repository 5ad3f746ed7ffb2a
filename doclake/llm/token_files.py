"""Token ids as Parquet files that can be read in part.

A file holds one row per document, in ascending order of its id: the shard, the
position of the row's first token within the shard, the number of tokens and the
ids as a list.  Ids are dictionary encoded, which is two bytes or less for
vocabularies up to 65,536; ids of documents, positions and counts ascend or vary
little and are delta encoded.  Row groups are bounded in bytes and pages in
rows, and Parquet's column and offset indexes say which pages hold which
documents, so a reader of a few documents, or of the columns without ids,
touches little of a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.llm import encoders
from doclake.llm.common import id_and_text, slices_by_bytes

BATCH_BYTES = 4 * 1024 * 1024

FILES = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"

FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "512",
    "parquet.dictionary.page.size": str(2 * 1024 * 1024),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#shard": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text and write the ids below ``path`` in order of the documents' ids.

    ``tokenizer`` names a vocabulary file that every executor has; ``end_id`` is
    appended to each document unless it is None.  A range shuffle brings the
    texts into order, and each of its parts is one shard: it is encoded as it is
    sorted, so no task holds more than a batch.  A shard that is run again after
    a loss gives the same rows.

    Null texts count as empty and hold the end id alone.  Rows with one id are
    ordered by text, null ids come first, other columns are left out, an empty
    table gives an empty folder of files with a schema.
    """
    end = b"" if end_id is None else encoders.pack([end_id])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = encoders.load(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, last in slices_by_bytes(texts, BATCH_BYTES):
                packed = [one + end for one in encoder.encode(texts.slice(first, last - first).to_pylist())]
                counts = np.array([len(one) // 4 for one in packed], np.int64)
                ends = np.cumsum(counts)
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(last - first, shard), pa.int32()),
                        ids.slice(first, last - first).cast(pa.int64()),
                        pa.array(start + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    ["shard", "doc_id", "shard_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, FILES).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as they were written; filters on ``doc_id`` and unused columns are pushed down."""
    return spark.read.schema(FILES).parquet(path)


def shard_offsets(files: DataFrame) -> DataFrame:
    """``(shard, shard_offset)``: the tokens of all shards before; one row per shard.

    Reads counts only.  The window sees one row per shard, of which there are as
    many as parts of the shuffle that wrote the files.
    """
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_offset"))


def with_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds ``start``, the position of the first token among the tokens of all documents.

    ``offsets`` (one row per shard) is small by the way the files were written.
    """
    found = rows.join(F.broadcast(offsets), "shard")
    return found.withColumn("start", F.col("shard_start") + F.col("shard_offset")).drop("shard_offset")


def checksums(files: DataFrame) -> DataFrame:
    """``(shard, doc_id, shard_start, n_tokens, ids_crc32)`` from the stored ids."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "doc_id", "shard_start", "n_tokens")), pa.array(sums, pa.int64())],
                ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"],
            )

    return files.mapInArrow(check, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
