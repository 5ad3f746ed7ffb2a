"""Markdown bodies: one file per document, or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import schemas
from doclake.functions import names


def with_identity(bodies: DataFrame) -> DataFrame:
    """``(document_id, file_name, markdown, modified_at)`` of whole-file text rows."""
    name = F.col("_metadata.file_name")
    return bodies.select(
        names.stem(name).alias("document_id"),
        name.alias("file_name"),
        F.col("value").alias("markdown"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.md`` of a folder, one row per file."""
    return with_identity(spark.read.text(path, wholetext=True, pathGlobFilter="*.md")).drop("modified_at")


def write_markdown(docs: DataFrame, path: str) -> None:
    """Keep bodies as a table; one file per document would not list well."""
    docs.select("document_id", "file_name", "markdown").write.mode("overwrite").parquet(path)


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MARKDOWN).parquet(path)
