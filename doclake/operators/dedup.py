"""Files that are copies of each other by name: which to keep, what to delete.

A group of copies is never collected or sorted: its size and the file to keep
are a count and a minimum, both built before the shuffle, so a group may hold
any share of the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions import names
from doclake.session import lookup_join


def duplicate_candidates(library: DataFrame) -> DataFrame:
    """``(key, file_name, duplicate_key, penalty)`` per file."""
    name = F.col("file_name")
    return library.select(
        "key", "file_name", names.duplicate_key(name).alias("duplicate_key"), names.name_penalty(name).alias("penalty")
    )


def duplicate_groups(library: DataFrame) -> DataFrame:
    """``(duplicate_key, n_files, n_delete, keep_key)`` of groups with more than one file.

    Kept is the file with the lowest penalty, then the shortest name, then the
    first key in listing order.
    """
    order = F.struct("penalty", F.length("file_name").alias("name_length"), "key")
    return (
        duplicate_candidates(library)
        .groupBy("duplicate_key")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min(order)["key"].alias("keep_key"))
        .where(F.col("n_files") > 1)
        .select("duplicate_key", "n_files", (F.col("n_files") - 1).alias("n_delete"), "keep_key")
    )


def duplicate_summary(library: DataFrame) -> DataFrame:
    """Number of groups and of files to delete."""
    return duplicate_groups(library).agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_delete"), F.lit(0)).alias("n_delete")
    )


def duplicate_files(library: DataFrame) -> DataFrame:
    """Every file of a group with its ``decision``: keep or delete."""
    groups = duplicate_groups(library).select("duplicate_key", "keep_key")
    return lookup_join(duplicate_candidates(library), groups, "duplicate_key", "inner").select(
        "duplicate_key",
        "key",
        "file_name",
        "penalty",
        F.when(F.col("key") == F.col("keep_key"), "keep").otherwise("delete").alias("decision"),
    )


def delete_plan(library: DataFrame) -> DataFrame:
    """The three stored objects of each file to delete.  A plan only; nothing is deleted."""
    stem = names.stem(F.col("file_name"))
    return (
        duplicate_files(library)
        .where(F.col("decision") == "delete")
        .select(
            stem.alias("document_id"),
            F.explode(
                F.array(
                    F.col("key"),
                    F.concat(F.lit("markdown/"), stem, F.lit(".md")),
                    F.concat(F.lit("json/"), stem, F.lit(".json")),
                )
            ).alias("object_key"),
        )
    )


def purge(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows (fragments or index) whose document is not among the deleted ones."""
    return lookup_join(df, deleted.select("document_id").distinct(), "document_id", "left_anti")
