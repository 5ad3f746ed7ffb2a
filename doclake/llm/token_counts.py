"""Token counts of whole texts: Arrow batches in, lengths out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from doclake.llm import encoders
from doclake.llm.common import id_and_text, slices_by_bytes

BATCH_BYTES = 4 * 1024 * 1024
LIMIT = 4096

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``path`` names a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file
    that every executor has.  The counts are those of the library for the whole
    text, without added special tokens; strings that look like special tokens
    are treated as the library does by default.

    Rows stay where they were read: there is no shuffle.  An Arrow batch is
    taken up in slices of about ``BATCH_BYTES`` of text, whatever the number of
    rows, and a text longer than a segment is cut where no token can cross
    (``encoders.segments``), so memory does not follow the longest row.

    Null and empty texts have no bytes and no tokens.  Repeated rows are counted
    each, null ids are kept, other columns of ``docs`` are left out, an empty
    table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders.load(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, end in slices_by_bytes(texts, BATCH_BYTES):
                part = texts.slice(start, end - start)
                lengths = [len(packed) // 4 for packed in encoder.encode(part.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, end - start).cast(pa.int64()),
                        pa.compute.binary_length(part).cast(pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([n > limit for n in lengths], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(count, COUNTS)
