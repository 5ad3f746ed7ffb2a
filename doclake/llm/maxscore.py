"""Exact top-k search over vectors of whole numbers by MaxScore.

Every dimension is a term whose postings hold the components of all vectors of a
shard.  For a query, a term adds at most ``bound = max(q * x)`` over the shard.
Terms are ordered by how far their contributions can lie apart; those that could
not lift a vector over the present threshold by themselves are non-essential.
Essential postings are traversed for all vectors of a block, and the others are
probed only for vectors whose partial score plus the bounds of the rest still
reaches the threshold.  Shards are searched on their own and their lists merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.session import stored

SHARD_ROWS = 8192
QUERY_ROWS = 2048
BLOCK_ROWS = 2048
K = 20
SCALE = 64


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` with components ``floor(scale * x)``.

    Vectors that are null or hold a null or non-finite component, and null ids,
    take no part.  Rows that share an id are candidates of their own.
    """
    number = F.col(vector_col)

    def unfit(x):
        value = x.cast("double")
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    fit = vectors.where(F.col(id_col).isNotNull() & number.isNotNull()).where(~F.exists(number, unfit))
    whole = F.transform(number, lambda x: F.floor(scale * x.cast("double")))
    return fit.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` candidates of highest inner product per query.

    Both tables are ``(vec_id, v)``; queries that share an id have one list, the
    best of all of them, and candidates that share one are told apart.  A vector shorter
    than the longest has zeros for the rest, and a candidate with the id of a
    query is not its partner.  Ties go to the smaller id; a query with fewer
    candidates gets all.

    Ids are dealt by hash, so no value of a vector or a label makes a shard
    large: a task sees one shard against one block of queries, both of bounded
    size, and returns at most ``k`` rows per query.
    """
    width = candidates.select(F.size("v").alias("n")).unionByName(queries.select(F.size("v").alias("n")))
    width = width.agg(F.max("n")).first()[0]
    n_rows, n_queries = candidates.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // SHARD_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    padded = F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width or 0)), 1, max(1, width or 0))

    def dealt(rows: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return rows.select(
            "vec_id",
            padded.alias("v"),
            F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other),
        )

    left = dealt(candidates, "shard", shards, "block", blocks)
    right = dealt(queries, "block", blocks, "shard", shards)
    key = ["shard", "block"]

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = maxscore(_ids(asked), _matrix(asked), _ids(rows), _matrix(rows), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    cells = left.groupBy(*key).cogroup(right.groupBy(*key))
    found = cells.applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _ids(rows: pa.Table) -> np.ndarray:
    return rows.column("vec_id").to_numpy().astype(np.int64)


def _matrix(rows: pa.Table) -> np.ndarray:
    values = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in rows.column("v").chunks]
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return flat.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1), np.int64)


def maxscore(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query_id, vec_id, score)`` of the best ``k`` rows of one shard for each query of a block."""
    none = np.zeros(0, np.int64)
    best = (none, none, none)  # query number, score, id
    if not len(ids) or not len(query_ids):
        return none, none, none
    # Sums of whole numbers are exact in doubles below 2**53; larger ones stay integers.
    limit = float(np.abs(queries).max()) * float(np.abs(rows).max()) * max(1, rows.shape[1])
    kind = np.float64 if limit < 2**53 else np.int64
    queries, postings = queries.astype(kind), np.ascontiguousarray(rows.T.astype(kind))
    high, low = postings.max(1), postings.min(1)
    bound = np.maximum(queries * high, queries * low)
    spread = bound - np.minimum(queries * high, queries * low)
    least = (bound - spread).sum(1)
    order = np.argsort(spread, axis=1, kind="stable")
    below = np.cumsum(np.take_along_axis(spread, order, 1), 1)
    threshold = np.full(len(queries), -np.inf)
    for start in range(0, len(ids), BLOCK_ROWS):
        block, block_ids = postings[:, start : start + BLOCK_ROWS], ids[start : start + BLOCK_ROWS]
        if not start:
            scores = (queries @ block).astype(np.float64 if kind is np.float64 else np.int64)
            at = np.nonzero(_reach(scores, query_ids, block_ids, k))
            found = scores[at]
        else:
            # Terms whose spreads together stay below what the threshold asks for.
            spare = np.empty_like(below, bool)
            np.put_along_axis(spare, order, below < (threshold - least)[:, None], 1)
            partial = np.where(spare, 0, queries) @ block
            rest = np.where(spare, bound, 0).sum(1)
            at = np.nonzero((partial + rest[:, None] >= threshold[:, None]) & (query_ids[:, None] != block_ids[None, :]))
            at, found = _probe(at, partial[at], queries, block, bound, spare, order, threshold)
        merged = (
            np.concatenate((best[0], at[0])),
            np.concatenate((best[1], found.astype(np.int64))),
            np.concatenate((best[2], block_ids[at[1]])),
        )
        best = _best(merged, k)
        full = np.bincount(best[0], minlength=len(queries)) >= k
        worst = np.full(len(queries), np.iinfo(np.int64).max)
        np.minimum.at(worst, best[0], best[1])
        threshold = np.where(full, worst, -np.inf)
    return query_ids[best[0]], best[2], best[1]


def _reach(scores: np.ndarray, query_ids: np.ndarray, block_ids: np.ndarray, k: int) -> np.ndarray:
    """Of the first block, where no threshold is known yet: the best ``k`` and their ties."""
    own = query_ids[:, None] == block_ids[None, :]
    if scores.shape[1] <= k + 1:
        return ~own
    # One more than k, as a query's own vector may be among the best.
    at = scores.shape[1] - k - 1
    return (scores >= np.partition(scores, at, axis=1)[:, at : at + 1]) & ~own


def _probe(at, partial, queries, block, bound, spare, order, threshold, step: int = 8):
    """Add non-essential terms, largest spread first, while a vector stays competitive."""
    rows, columns = at
    for first in range(order.shape[1], 0, -step):
        if not len(rows):
            break
        terms = order[:, max(0, first - step) : first]
        wanted = np.take_along_axis(spare, terms, 1)
        if not wanted.any():
            continue
        weight = np.where(wanted, np.take_along_axis(queries, terms, 1), 0)
        # What the terms still to come can add to each query at most.
        left = order[:, : max(0, first - step)]
        rest = np.where(np.take_along_axis(spare, left, 1), np.take_along_axis(bound, left, 1), 0).sum(1)
        kept_rows, kept_columns, kept = [], [], []
        for start in range(0, len(rows), 200_000):
            r, c = rows[start : start + 200_000], columns[start : start + 200_000]
            score = partial[start : start + 200_000] + (weight[r] * block[terms[r], c[:, None]]).sum(1)
            stays = score + rest[r] >= threshold[r]
            kept_rows.append(r[stays])
            kept_columns.append(c[stays])
            kept.append(score[stays])
        rows, columns, partial = map(np.concatenate, (kept_rows, kept_columns, kept))
    return (rows, columns), partial


def _best(found, k: int):
    """The best ``k`` per query: highest score, then smallest id."""
    query, score, ids = found
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    begin = np.searchsorted(query, query, side="left")
    top = np.arange(len(query)) - begin < k
    return query[top], score[top], ids[top]


def search(vectors: DataFrame, is_query: F.Column, k: int = K) -> DataFrame:
    """The stated queries among the rows of a table of vectors, against all its rows."""
    rows = stored(quantised(vectors), "vectors")
    return top_k(rows, rows.where(is_query), k)
