"""Listings of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions import names


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(key, file_name, stem, suffix, size_bytes)`` of all files below a folder.

    Only path and length are selected, so no file is opened.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    name = names.basename(F.col("path"))
    return found.where(name != "").select(
        F.col("path").alias("key"),
        name.alias("file_name"),
        names.stem(name).alias("stem"),
        names.suffix(name).alias("suffix"),
        F.col("length").alias("size_bytes"),
    )


def list_library(spark: SparkSession, path: str) -> DataFrame:
    """The listing restricted to supported document formats."""
    return list_files(spark, path).where(names.is_supported(F.col("file_name")))
