"""Positions inside groups that may be very large.

``row_number() over (partition by g order by ...)`` sorts a whole group in one
task.  Here the order is split in two: a coarse part that cuts a group into
blocks, and a fine part inside a block.  Row counts per block are aggregated
before the shuffle, a running sum over them gives each block its start, and
only the rows of one block meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def block_starts(df: DataFrame, group: Sequence[str], coarse: Sequence[str], weight: Column) -> DataFrame:
    """``(group, coarse, block_start, group_total)`` from a two-step aggregate."""
    sizes = df.groupBy(*group, *coarse).agg(F.sum(weight).alias("_size"))
    ordered = Window.partitionBy(*group).orderBy(*coarse)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return sizes.select(
        *group,
        *coarse,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("block_start"),
        F.sum("_size").over(whole).alias("group_total"),
    )


def with_position(df: DataFrame, group: Sequence[str], coarse: Sequence[str], fine: Sequence[Column | str]) -> DataFrame:
    """Add ``position`` (from 1) and ``group_total``, ordering by ``coarse`` then ``fine``.

    ``coarse`` columns are sorted ascending, so store a descending one negated.
    They must not be null, as they are join keys here.
    """
    starts = block_starts(df, group, coarse, F.lit(1))
    inside = Window.partitionBy(*group, *coarse).orderBy(*fine)
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(starts, [*group, *coarse])
        .withColumn("position", F.col("block_start") + F.col("_inside"))
        .drop("_inside", "block_start")
    )
