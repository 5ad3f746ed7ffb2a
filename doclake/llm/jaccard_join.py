"""Jaccard similarity join on word shingles by rare-first prefix filtering.

Two sets can only reach the threshold if their *prefixes* share an element: the
first ``|x| - ceil(t |x|) + 1`` elements in one order of all shingles.  With the
rarest first, few prefixes meet.  Candidates must also agree in length, leave
enough elements after the place where they meet (positions), and not differ by
too much in how many elements fall into each part of the hash space (suffixes).
What is left is verified once per pair on the whole sets.

Groups of copies never become pairs.  Texts with equal sets are one class with
one representative.  A shingle in more than ``PAIR_GROUP`` prefixes gives a
forest over the pairs that pass the filters, one in more than ``WIDE_GROUP`` a
chain through its classes.  Candidates only say which classes are compared, and
all pairs within a cluster of candidates are, so nothing is lost.  A cluster that is too large for a task is
cut into cells: blocks of classes of like size, compared block against block,
first by the filters alone, which leaves smaller clusters, then by the texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import bounded_batches, giving_back, slices_by_bytes
from doclake.llm.components import components, roots
from doclake.llm.shingles import mix, shingle_sets
from doclake.session import broadcast_if, fits_broadcast, lookup_join, stored

SHINGLE_WORDS = 5
THRESHOLD = 80  # in hundredths

BATCH_BYTES = 1024 * 1024
SKETCH_BITS, SKETCH_PARTS = 20, 64
SUFFIX_PARTS, PER_PART = 16, 8
PAIR_GROUP, LOCAL_GROUP, WIDE_GROUP = 8, 512, 4096
CHAIN, PAIR, WIDE = 0, 1, 2
POSTINGS_PER_BUCKET = 100_000
CLUSTER_ROWS = 512
BIN_ROWS = 1024
# Small clusters are put together up to about so many shingles.
BIN_SHINGLES = 1_000_000

DIGEST = "doc_id long, has_id boolean, version long, n long, node long, prefix binary, suffix binary"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return bounded_batches(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
        F.col(id_col).isNotNull().alias("has_id"),
        F.xxhash64(text).alias("version"),
        text.alias("text"),
    )


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur in all documents, counted in ``2**SKETCH_BITS`` slots.

    The sketch only orders the shingles, so slots that several share change the
    number of candidates and no result.  Its size does not depend on the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for start, end in slices_by_bytes(texts, BATCH_BYTES):
                found, _ = shingle_sets(texts.slice(start, end - start), size)
                total += np.bincount(_slots(found), minlength=len(total))
        if total.any():
            parts = [part.tobytes() for part in np.split(total, SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts)], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], ["part", "counts"])

    schema = "part int, counts binary"
    sums = rows.select("text").mapInArrow(giving_back(count), schema).groupBy("part").applyInArrow(add, schema).collect()
    total = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for row in sums:
        total[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(total.reshape(-1), np.iinfo(np.uint32).max).astype(np.uint32)


def digests(rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """Per row the size of its set, its class, its prefix (rarest first) and the parts of its hashes."""
    counts = rows.sparkSession.sparkContext.broadcast(frequencies(rows, size))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for batch in batches:
            for start, end in slices_by_bytes(batch.column("text"), BATCH_BYTES):
                part = batch.slice(start, end - start)
                found, bounds = shingle_sets(part.column("text"), size)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(found), dtype=np.uint64)))
                node = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)
                order = np.lexsort((found, frequency[_slots(found)], owner))
                rare = found[order]
                cut = n - -(-threshold * n // 100) + 1
                # Parts of the hash space, a power of two that grows with the set.
                parts = np.maximum(SUFFIX_PARTS, 1 << np.frexp(np.maximum(n, 1) / PER_PART)[1].astype(np.int64))
                ends = np.cumsum(parts)
                spread = np.bincount((ends - parts)[owner] + (found.astype(np.int64) & (parts - 1)[owner]), minlength=int(ends[-1]))
                spread = np.minimum(spread, 255).astype("u1")
                prefixes = [rare[b : b + c].tobytes() if k else b"" for b, c, k in zip(bounds, cut, n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "has_id", "version")),
                        pa.array(n, pa.int64()),
                        pa.array(node, pa.int64()),
                        pa.array(prefixes, pa.binary()),
                        pa.array([spread[e - p : e].tobytes() for e, p in zip(ends, parts)], pa.binary()),
                    ],
                    ["doc_id", "has_id", "version", "n", "node", "prefix", "suffix"],
                )

    return rows.mapInArrow(giving_back(digest), DIGEST)


def _postings(classes: DataFrame, threshold: int) -> DataFrame:
    """``(kind, x, y, place)``: chains and candidate pairs of classes, members of wide groups.

    Postings travel packed by bucket of the shingle.  A shingle that already has
    more than ``LOCAL_GROUP`` classes in one batch is chained there, by size and
    with a break where sizes differ too much.  Of each piece only the first class
    goes on, with the number of its classes as weight and the largest size as
    top, so a shingle of a third of all classes sends a few rows per task.  Of a
    wide group, ``x`` is the shingle and ``y`` the class.
    """
    total = classes.agg(F.coalesce(F.sum(F.length("prefix") / 8), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // POSTINGS_PER_BUCKET))
    schema = "bucket int, shingle binary, node binary, n binary, place binary, weight binary, top binary"
    names = ["shingle", "node", "n", "place", "weight", "top"]
    kinds = ("<u8", "<i8", "<u4", "<u4", "<u4", "<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix")
            lengths = np.array([len(p) // 8 for p in prefixes.to_pylist()], np.int64)
            shingle = np.frombuffer(b"".join(prefixes.to_pylist()), "<u8")
            node = np.repeat(batch.column("node").to_numpy(), lengths)
            n = np.repeat(batch.column("n").to_numpy(), lengths)
            place = np.arange(len(shingle)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.lexsort((n, shingle))
            shingle, node, n, place = shingle[order], node[order], n[order], place[order]
            first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(shingle)))
            kept = ~np.repeat(size > LOCAL_GROUP, size)
            kept[first] = True
            kept[1:] |= 100 * n[:-1] < threshold * n[1:]
            chained = np.flatnonzero(~kept)
            chain = (node[chained], node[chained - 1])
            heads = np.flatnonzero(kept)
            weight = np.diff(np.append(heads, len(shingle)))
            top = n[heads + weight - 1]
            shingle, node, n, place = shingle[heads], node[heads], n[heads], place[heads]
            bucket = (shingle % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            numbers, begin = np.unique(bucket[order], return_index=True)
            ends = np.append(begin[1:], len(order))
            out = [[int(b) for b in numbers], *([] for _ in names)]
            for b, e in zip(begin, ends):
                at = order[b:e]
                for column, values, kind in zip(out[1:], (shingle, node, n, place, weight, top), kinds):
                    column.append(values[at].astype(kind).tobytes())
            if len(chained):
                # Bucket -1 holds finished chains.
                for column, values in zip(out, (-1, chain[0].tobytes(), chain[1].tobytes(), b"", b"", b"", b"")):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", *names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {name: [] for name in names}
        for batch in batches:
            for name in names:
                columns[name] += batch.column(name).to_pylist()
        values = [np.frombuffer(b"".join(columns[name]), kind) for name, kind in zip(names, kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in _meet(*values, threshold)], ["kind", "x", "y", "place"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("shingle", "node"))
            none = np.zeros(len(x), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (none, x, y, none)], ["kind", "x", "y", "place"])

    edge = "kind int, x long, y long, place int"
    packed = stored(classes.select("node", "n", "prefix").mapInArrow(giving_back(pack), schema), "postings")
    met = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, edge)
    return met.unionByName(packed.where("bucket < 0").mapInArrow(unpack, edge)).distinct()


def _meet(shingle, node, n, place, weight, top, threshold: int):
    """Rows of one bucket: filtered pairs of small groups, members of wide ones, chains of the largest."""
    # Within a shingle by size, so that partners of like length are neighbours.
    order = np.lexsort((node, n, shingle))
    n, place, top = (v.astype(np.int64) for v in (n, place, top))
    shingle, node, n, place, weight, top = (v[order] for v in (shingle, node, n, place, weight, top))
    if not len(shingle):
        return np.zeros(0, np.int32), node, node, np.zeros(0, np.int32)
    first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    size = np.diff(np.append(first, len(shingle)))
    total = np.add.reduceat(weight.astype(np.int64), first)
    # A group that was chained in part before must be chained on.
    chain = np.repeat((total > WIDE_GROUP) | (total > size), size)
    wide = np.repeat(total > PAIR_GROUP, size) & ~chain
    in_group = np.arange(len(shingle)) - np.repeat(first, size)
    rows = []
    # Where a class is too large for all before it, those behind their heads
    # included, so are all after it: a break parts no pair that may be linked.
    group = np.repeat(np.arange(len(size)), size) << 32
    reach = np.maximum.accumulate(group + top) - group
    b = np.flatnonzero(chain & (in_group > 0))
    b = b[100 * reach[b - 1] >= threshold * n[b]]
    rows.append((CHAIN, node[b - 1], node[b], np.zeros(len(b), np.int64)))
    b = np.flatnonzero(wide)
    rows.append((WIDE, shingle[b].view(np.int64), node[b], place[b]))
    for gap in range(1, PAIR_GROUP):
        b = np.flatnonzero(~chain & ~wide & (in_group >= gap))
        a = b - gap
        fits = _lengths_and_places_allow(n[a], n[b], place[a], place[b], threshold)
        x, y = node[a[fits]], node[b[fits]]
        rows.append((PAIR, np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64)))
    kind = np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in rows])
    x, y, place = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
    return kind, x, y, place.astype(np.int32)


def _lengths_and_places_allow(n_a, n_b, place_a, place_b, threshold: int):
    """Whether sizes are alike, and enough elements are left around the one that both share."""
    need = -(-threshold * (n_a + n_b) // (100 + threshold))
    most = np.minimum(place_a, place_b) + np.minimum(n_a - place_a, n_b - place_b)
    return (100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)) & (most >= need)


def _folded(parts: np.ndarray, size: int) -> np.ndarray:
    """Counts of fewer parts; parts are the low bits of the hash, so halves add up."""
    while parts.shape[-1] > size:
        half = parts.shape[-1] // 2
        # Counts are cut at 255 on either side, so a difference is never too large.
        parts = np.minimum(parts[..., :half] + parts[..., half:], 255)
    return parts


def _spreads_allow(differ, n_a, n_b, threshold: int):
    """At least ``differ`` elements are in one of the sets only."""
    return (100 + threshold) * differ <= (100 - threshold) * (n_a + n_b)


def _candidates(rows: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Edges ``(x, y)``: chains, pairs that the suffixes allow, and forests of wide groups."""
    thin = stored(classes.select("node", "n", "suffix"), "suffixes")
    few = fits_broadcast(thin)
    sides = [thin.select(*(F.col(c).alias(f"{c}_{side}") for c in thin.columns)) for side in "xy"]
    rows = stored(rows, "candidates")
    pairs = rows.where(F.col("kind") == PAIR).join(broadcast_if(few, sides[0]), F.col("x") == F.col("node_x"))
    pairs = pairs.join(broadcast_if(few, sides[1]), F.col("y") == F.col("node_y"))
    wide = rows.where(F.col("kind") == WIDE).join(broadcast_if(few, sides[1]), F.col("y") == F.col("node_y"))

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = []
            for a, b in zip(batch.column("suffix_x").to_pylist(), batch.column("suffix_y").to_pylist()):
                size = min(len(a), len(b))
                a, b = (_folded(np.frombuffer(v, "u1").astype(np.int64), size) for v in (a, b))
                differ.append(int(np.abs(a - b).sum()))
            kept = _spreads_allow(np.array(differ, np.int64), *(batch.column(c).to_numpy() for c in ("n_x", "n_y")), threshold)
            yield batch.select(["x", "y"]).filter(pa.array(kept, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        node, n, place = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "n_y", "place"))
        x, y = _wide_forest(n, place, table.column("suffix_y").to_pylist(), threshold)
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["x", "y"])

    edge = "x long, y long"
    met = pairs.select("x", "y", "n_x", "n_y", "suffix_x", "suffix_y").mapInArrow(allow, edge)
    forests = wide.select("x", "y", "n_y", "place", "suffix_y").groupBy("x").applyInArrow(compare, edge)
    return rows.where(F.col("kind") == CHAIN).select("x", "y").unionByName(met).unionByName(forests)


def _wide_forest(
    n: np.ndarray, place: np.ndarray, suffixes: list[bytes], threshold: int, side: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the members of one wide group that pass all filters, block by block.

    Where there are two sides, only pairs across them are compared.
    """
    parts = np.array([len(s) for s in suffixes])
    root = np.arange(len(n))
    every = np.ones(len(n), bool)
    across = [(every, every)] if side is None or side.all() or not side.any() else [(side, ~side), (~side, side)]
    for size, (here, there) in itertools.product(np.unique(parts).tolist(), across):
        # Sizes that are alike have as many parts, or twice as many.
        left, right = np.flatnonzero((parts == size) & here), np.flatnonzero(((parts == size) | (parts == 2 * size)) & there)
        if not len(left) or not len(right):
            continue
        a = np.stack([np.frombuffer(suffixes[k], "u1") for k in left]).astype(np.int16)
        b = np.stack([_folded(np.frombuffer(suffixes[k], "u1").astype(np.int16), size) for k in right])
        step = max(1, 4_000_000 // (len(right) * size))
        for start in range(0, len(left), step):
            rows = left[start : start + step]
            differ = np.abs(a[start : start + step, None, :] - b[None, :, :]).sum(2, dtype=np.int64)
            fits = _spreads_allow(differ, n[rows][:, None], n[right][None, :], threshold)
            fits &= _lengths_and_places_allow(n[rows][:, None], n[right][None, :], place[rows][:, None], place[right][None, :], threshold)
            i, j = np.nonzero(fits)
            ends = np.unique(np.stack((root[rows[i]], root[right[j]])), axis=1)
            root = roots(len(n), np.concatenate((np.arange(len(n)), ends[0])), np.concatenate((root, ends[1])))
    hung = np.flatnonzero(root != np.arange(len(n)))
    return hung, root[hung]


def _links(node: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one cell: pairs across the sides, or all pairs where there is one side."""
    n = np.array([len(s) for s in sets], np.int64)
    shingle = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    first = np.append(True, shingle[1:] != shingle[:-1])
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.cumsum(first[shared]) - 1
    overlap = np.zeros((len(sets), len(sets)), np.int64)
    # Products of 0/1 matrices, a range of shingles at a time.
    columns = max(1, 4_000_000 // len(sets))
    edges = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else 0) + columns + 1, columns))
    for b, e in zip(edges[:-1], edges[1:]):
        if b < e:
            matrix = np.zeros((len(sets), columns), np.float32)
            matrix[owner[b:e], number[b:e] % columns] = 1
            overlap += (matrix @ matrix.T).astype(np.int64)
    linked = 100 * overlap >= threshold * (n[:, None] + n[None, :] - overlap)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    x, y = np.nonzero(np.triu(linked, 1))
    return x, y


def similar_classes(rows: DataFrame, size: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows, classes of equal sets, and ``(node, root)`` of linked classes."""
    digest = stored(digests(rows, size, threshold), "digests")
    example = F.any_value(F.struct("doc_id", "has_id", "version", "n", "prefix", "suffix"))
    keeper = F.min(F.struct((~F.col("has_id")).alias("no_id"), "doc_id", "version"))
    classes = digest.where("n > 0").groupBy("node").agg(keeper.alias("keeper"), F.count("*").alias("rows"), example.alias("e"))
    classes = stored(classes.select("node", "keeper", "rows", "e.*"), "classes")
    edges = _candidates(_postings(classes, threshold), classes, threshold)
    clusters = stored(components(edges).withColumnRenamed("root", "cluster"), "clusters")
    clusters = _refined(classes, clusters, threshold)
    links = stored(_verified(rows, classes, clusters, size, threshold), "links")
    return digest, classes, components(links)


def _refined(classes: DataFrame, clusters: DataFrame, threshold: int) -> DataFrame:
    """Clusters of which those too large for one cell are clustered anew by the pairs that pass the filters."""
    sized = clusters.groupBy("cluster").agg(F.count("*").alias("members")).where(F.col("members") > CLUSTER_ROWS)
    sized = stored(sized.select("cluster"), "large")
    if sized.isEmpty():
        return clusters
    members = clusters.join(sized, "cluster").join(classes.select("node", "n", "suffix"), "node")
    cells = stored(_large_cells(stored(members, "members"), threshold, ["node", "n", "suffix"]), "cells")
    cells = cells.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-cells.count() // BIN_ROWS)))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        cell, node, n = (table.column(c).to_numpy().astype(np.int64) for c in ("cell", "node", "n"))
        side, suffix = table.column("side").to_numpy(zero_copy_only=False).astype(bool), table.column("suffix")
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(cell, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            # From place 0 on, only sizes and spreads count.
            x, y = _wide_forest(n[at], np.zeros(len(at), np.int64), suffix.take(pa.array(at)).to_pylist(), threshold, side[at])
            xs.append(node[at[x]])
            ys.append(node[at[y]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])

    edges = cells.groupBy("bin").applyInArrow(compare, "x long, y long")
    parts = components(edges).withColumnRenamed("root", "cluster")
    return stored(clusters.join(sized, "cluster", "left_anti").select("node", "cluster").unionByName(parts), "clusters")


def _verified(rows: DataFrame, classes: DataFrame, clusters: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links ``(x, y)`` between classes, as a forest of each cell."""
    sized = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    members = stored(clusters.join(sized, "cluster").join(classes, "node"), "members")
    small = members.where(F.col("members") <= CLUSTER_ROWS).select(
        "doc_id", "has_id", "version", "node", F.col("cluster").alias("cell"), F.lit(False).alias("side")
    )
    large = _large_cells(members.where(F.col("members") > CLUSTER_ROWS), threshold, ["doc_id", "has_id", "version", "node"])
    # A cell of a large cluster is a group of its own; small clusters share one by their size in shingles.
    total = members.where(F.col("members") <= CLUSTER_ROWS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(1, -(-int(total) // BIN_SHINGLES))
    cells = small.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(bins))).unionByName(large.withColumn("bin", F.col("cell")))
    texts = lookup_join(rows, cells, ["doc_id", "has_id", "version"], "inner").select("bin", "cell", "side", "node", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, side, node, sets = [], [], [], []
        for batch in batches:
            for start, end in slices_by_bytes(batch.column("text"), BATCH_BYTES):
                found, bounds = shingle_sets(batch.column("text").slice(start, end - start), size)
                # A copy, as a part keeps the arrays of the whole slice alive.
                sets += [found[b:e].copy() for b, e in zip(bounds[:-1], bounds[1:])]
            for column, name in ((cell, "cell"), (side, "side"), (node, "node")):
                column.append(batch.column(name).to_numpy(zero_copy_only=False))
        cell, side, node = (np.concatenate(c) for c in (cell, side, node))
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.lexsort((node, cell))
        # A document listed twice is one member.
        again = np.append(False, (cell[order][1:] == cell[order][:-1]) & (node[order][1:] == node[order][:-1]))
        order = order[~again]
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            x, y = _links(node[at], [sets[k] for k in at], side[at], threshold)
            root = roots(len(at), x, y)
            hung = np.flatnonzero(root != np.arange(len(at)))
            xs.append(node[at[hung]])
            ys.append(node[at[root[hung]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])

    return texts.groupBy("bin").applyInArrow(giving_back(verify), "x long, y long")


def _large_cells(members: DataFrame, threshold: int, row: list[str]) -> DataFrame:
    """Cells of clusters that are too large for one: blocks of like size against blocks, with the columns of ``row``.

    Sizes fall into bands so that sets in bands that are not neighbours cannot
    reach the threshold; a band is dealt into blocks by hash.  Every pair of
    classes that may be linked meets in exactly one cell.
    """
    half = CLUSTER_ROWS // 2
    # A little wider than the threshold asks for, so rounding moves nothing past the next band.
    width = math.log(100 / threshold) * (1 + 1e-9)
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long"))
    sizes = banded.groupBy("cluster", "band").agg(F.ceil(F.count("*") / half).cast("long").alias("blocks"))
    wide = sizes
    for step, name in ((1, "above"), (-1, "below")):
        other = sizes.select("cluster", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
        wide = wide.join(other, ["cluster", "band"], "left")
    dealt = lookup_join(banded, wide, ["cluster", "band"], "inner")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    place = ["cluster", "band", "block", "blocks", "above", "below"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell, side = [], [], []
            for n, (cluster, band, block, blocks, above, below) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in place))
            ):
                met = [((band, min(block, k), band, max(block, k)), block > k) for k in range(blocks)]
                met += [((band, block, band + 1, k), False) for k in range(above or 0)]
                met += [((band - 1, k, band, block), True) for k in range(below or 0)]
                at += [n] * len(met)
                cell += [hash((cluster, *where)) for where, _ in met]
                side += [s for _, s in met]
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in row]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int64()), pa.array(side, pa.bool_())], [*row, "cell", "side"])

    kinds = dict(members.dtypes)
    return dealt.select(*row, *place).mapInArrow(assign, ", ".join(f"{c} {kinds[c]}" for c in row) + ", cell long, side boolean")


def groups(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, version, n_shingles, component_id, stays)``, one row per row of ``docs``.

    ``component_id`` is the smallest id that links of at least ``threshold``
    hundredths reach, the document's own included, null if none of them has an
    id; ``stays`` marks the one document that stands for the group (smallest id,
    then a hash of the text).  Lower case of A-Z; words are runs of characters
    other than ASCII white space.  A text with fewer than ``size`` words is one
    shingle, and texts without words (null, empty) are linked with nothing.
    Rows that repeat id and text are one document and share its verdict.
    """
    digest, classes, linked = similar_classes(_rows(docs, id_col, text_col), size, threshold)
    grouped = classes.select("node", "keeper", "rows").join(linked, "node", "left")
    grouped = grouped.where("rows > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    keepers = grouped.groupBy("root").agg(F.min("keeper").alias("keeper"))
    known = grouped.select("node", "root").join(keepers, "root").select("node", "keeper")
    found = lookup_join(digest.drop("prefix", "suffix"), known, "node", "left")
    own = F.struct((~F.col("has_id")).alias("no_id"), "doc_id", "version")
    single = F.col("keeper").isNull()
    own_id = F.when(F.col("has_id"), F.col("doc_id"))
    return found.select(
        own_id.alias("doc_id"),
        "version",
        F.col("n").alias("n_shingles"),
        F.when(single, own_id).when(~F.col("keeper.no_id"), F.col("keeper.doc_id")).alias("component_id"),
        (single | (F.col("keeper") == own)).alias("stays"),
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar ones, same columns."""
    gone = groups(docs, size, threshold, id_col, text_col).where("not stays").select(
        F.coalesce("doc_id", F.lit(0)).alias("gone_id"), F.col("doc_id").isNotNull().alias("gone_has"), F.col("version").alias("gone_version")
    )
    gone = stored(gone.distinct(), "gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = (
        (F.coalesce(F.col(id_col).cast("long"), F.lit(0)) == F.col("gone_id"))
        & (F.col(id_col).isNotNull() == F.col("gone_has"))
        & (F.xxhash64(text) == F.col("gone_version"))
    )
    return docs.join(broadcast_if(fits_broadcast(gone), gone), same, "left_anti")
