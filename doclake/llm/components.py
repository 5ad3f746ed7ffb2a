"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.session import stored


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` numbered nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(root, before):
            return root


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch replaced by one edge from each node to the smallest it reaches there."""
    for batch in batches:
        x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
        nodes, number = np.unique(np.concatenate((x, y)), return_inverse=True)
        top = nodes[roots(len(nodes), number[: len(x)], number[len(x) :])] if len(nodes) else nodes
        kept = nodes != top
        yield pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(top[kept])], ["x", "y"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the ends of edges ``(x, y)``: the smallest node of the component.

    Each round moves the larger neighbours of every node to the smallest node it
    knows, then the smaller ones (large star, small star), until every node hangs
    on its root; the number of rounds grows with the logarithm of the table.  A
    node with very many neighbours is aggregated to one row before it is joined,
    and no neighbourhood is ever collected.  Each round is written to the shared
    folder, which cuts the lineage.
    """
    edges = edges.where("x <> y").mapInArrow(forest, "x long, y long").distinct()
    edges, state = stored(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("least"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y"))
        large = stored(large.where("x <> y").distinct(), "edges")
        # Every edge now points to a smaller node.
        least = large.groupBy("x").agg(F.min("y").alias("least"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y"))
        edges = stored(small.where("x <> y").unionByName(least.select("x", F.col("least").alias("y"))).distinct(), "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    both = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return both.unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
