"""Error events reported by browsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["timestamp", "message", "source", "lineno", "colno", "stack"]


def client_errors(reports: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Reports with the time they came in, as epoch seconds; works on batches and streams."""
    at = F.current_timestamp() if received_at is None else received_at
    return reports.withColumn("timestamp", at.cast("double")).select(*COLUMNS)


def append_client_errors(reports: DataFrame, path: str) -> None:
    client_errors(reports).write.mode("append").parquet(path)
