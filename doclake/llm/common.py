"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)``: a null text is an empty one, other columns are left out.

    Selecting these two also settles any clash with a column an operator adds.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MAX_BATCH = "4m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session that sends Python at most ``MAX_BATCH`` of rows at once.

    Spark's own limit, 64 MB or 10,000 rows, is held twice by the JVM and Python of
    each running task.  A limit that the user has set stays; one longer row is sent alone.
    """
    conf = df.sparkSession.conf
    if ARROW_BYTES not in conf.getAll:
        conf.set(ARROW_BYTES, MAX_BATCH)
    return df


def per_batch(build: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]):
    """A function for ``mapInArrow`` whose state (a model, a cache) is made in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            yield from step(batch)

    return run


def give_back() -> None:
    """Return memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function for ``mapInArrow``; what its arrays took goes back to the system with the task.

    A Python worker outlives its tasks and would hold memory that later stages need.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices_by_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text each (at least one row)."""
    start = size = 0
    lengths = pa.compute.binary_length(column).to_pylist()
    for row, length in enumerate(lengths):
        if row > start and size + (length or 0) > limit:
            yield start, row
            start, size = row, 0
        size += length or 0
    if len(lengths) > start:
        yield start, len(lengths)
